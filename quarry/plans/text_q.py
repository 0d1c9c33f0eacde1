"""Text and retrieval queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry import config
from quarry.operators import textops as TX
from quarry.operators import vector as VX
from quarry.plans.cache import materialized_plan
from quarry.plans.registry import finalize, query
from quarry.sources.tables import load

_ABBR = "|".join(a.replace(".", "\\.") for a in config.ABBREVIATIONS)
CLEAN = ("regexp_replace(replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), "
         "chr(0), ''), '^\\s+|\\s+$', '', 'g')")
SENT_SQL = f"""
d AS (SELECT doc_id, {CLEAN} AS t FROM documents),
p0 AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\n\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
  lambda x: x <> '') AS ps FROM d),
p AS (SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) - 1 AS para_idx FROM p0),
s0 AS (SELECT doc_id, para_idx, list_filter(list_transform(string_split(regexp_replace(regexp_replace(para,
  '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\b({_ABBR})\\.' || chr(1), '\\1. ', 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM p),
s AS (SELECT doc_id, para_idx, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS sent_idx FROM s0)"""
_WC = "CASE WHEN regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(sentence, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"


@query("v1_sentences", "WITH " + SENT_SQL + f"""
SELECT doc_id, CAST(para_idx AS BIGINT) AS para_idx, CAST(sent_idx AS BIGINT) AS sent_idx, sentence,
  CAST(length(sentence) AS BIGINT) AS n_chars, CAST({_WC} AS BIGINT) AS n_words FROM s""")
def q_v1(spark, sf):
    return finalize(TX.sentences(load(spark, sf, "documents", ["doc_id", "text"])))


@materialized_plan
def chunks(spark, sf):
    return TX.chunk_documents(load(spark, sf, "documents", ["doc_id", "text"]))


@query("v2_v4_chunks")
def q_v2(spark, sf):
    return finalize(chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id", "char_count", "word_count"))


@query("v14_corpus_stats")
def q_v14(spark, sf):
    return finalize(TX.corpus_stats(chunks(spark, sf), load(spark, sf, "documents", ["doc_id", "source", "lang"])))


@query("v16_exact_dedup", """
SELECT d.doc_id, d.source, h.copies FROM documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS copies
  FROM documents GROUP BY 1) h USING (doc_id)""")
def q_v16(spark, sf):
    return finalize(TX.dedup_exact(load(spark, sf, "documents", ["doc_id", "text", "source"])).select("doc_id", "source", "copies"))


@query("p28_content_hash", """
SELECT doc_id, substring(md5(text), 1, 12) AS chunk_hash, substring(md5(text), 1, 16) AS key_hash,
  sha256(text) AS full_hash FROM documents""")
def q_p28(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "text"])
    return finalize(d.select("doc_id", TX.content_hash(F.col("text"), 12).alias("chunk_hash"),
                             TX.content_hash(F.col("text"), 16).alias("key_hash"), F.sha2("text", 256).alias("full_hash")))


_KW = "the"
_REL_SQL = f"""
r AS (SELECT doc_id, source, n_chars,
  CAST((length(lower(text)) - length(replace(lower(text), '{_KW}', ''))) / {len(_KW)} AS BIGINT) AS occurrences,
  CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS words
  FROM documents),
r2 AS (SELECT *, CASE WHEN words > 0 THEN (length(lower(text)) - length(replace(lower(text), '{_KW}', ''))) / {len(_KW)} / words ELSE 0.0 END AS relevance
  FROM r JOIN (SELECT doc_id, text FROM documents) USING (doc_id))"""


@query("v17_keyword_relevance_top", "WITH " + _REL_SQL + """
SELECT doc_id, source, occurrences, CAST(words AS BIGINT) AS words, round(relevance, 6) AS relevance FROM r2
ORDER BY relevance DESC, doc_id ASC LIMIT 20""")
def q_v17(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "text", "source"])
    r = TX.keyword_relevance(d, _KW)
    return finalize(r.orderBy(F.col("relevance").desc(), F.col("doc_id").asc()).limit(20))


@query("v13_context_pack", "WITH " + _REL_SQL + f""",
c AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY relevance DESC, doc_id ASC ROWS UNBOUNDED PRECEDING) AS cum FROM r2),
c2 AS (SELECT *, max(CAST(cum > {config.CONTEXT_BUDGET_CHARS} AS INTEGER)) OVER (PARTITION BY source ORDER BY relevance DESC, doc_id ASC
  ROWS UNBOUNDED PRECEDING) AS over FROM c)
SELECT source, doc_id, n_chars, CAST(cum AS BIGINT) AS cumulative_chars, round(relevance, 6) AS relevance FROM c2 WHERE over = 0""")
def q_v13(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "text", "source", "n_chars"])
    r = TX.keyword_relevance(d, _KW).join(d.select("doc_id", "n_chars"), "doc_id")
    p = TX.context_pack(r, "source", [F.col("relevance").desc(), F.col("doc_id").asc()], "n_chars")
    return finalize(p.select("source", "doc_id", "n_chars", "cumulative_chars", "relevance"))


_VEC_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
cent AS (SELECT label AS query_id, list(m ORDER BY i) AS qvec FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) GROUP BY label),
sc AS (SELECT c.query_id, e.vec_id, e.label, list_cosine_similarity(e.v, c.qvec) AS score FROM e, cent c)"""


@query("v6_vector_topk", "WITH " + _VEC_SQL + f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC) AS rank FROM sc) WHERE rank <= {config.TOP_K}""")
def q_v6(spark, sf):
    e = load(spark, sf, "embeddings")
    r = VX.cosine_topk(e, VX.label_centroids(e))
    return finalize(r.select("query_id", "vec_id", "score", "rank"))


@query("v9_vector_topk_filtered", "WITH " + _VEC_SQL + f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC) AS rank FROM sc
  WHERE label % 2 = 0 AND score >= 0.0) WHERE rank <= {config.TOP_K}""")
def q_v9(spark, sf):
    e = load(spark, sf, "embeddings")
    r = VX.cosine_topk(e, VX.label_centroids(e), where=F.col("label") % 2 == 0, min_score=0.0)
    return finalize(r.select("query_id", "vec_id", "score", "rank"))


@query("v5_v8_hybrid_search")
def q_v8(spark, sf):
    docs = load(spark, sf, "documents", ["doc_id", "text"])
    bench = load(spark, sf, "benchmark", ["item_id", "text"])
    corpus, (qs,) = VX.embed_text(docs, [bench])
    queries = qs.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("qvec"))
    hits = VX.hybrid_search(corpus, queries, "the")
    return finalize(hits.select("query_id", "doc_id", "score", "rank"))
