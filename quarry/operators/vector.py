"""Vector retrieval (V5-V9): exact cosine top-k.

Queries are broadcast in blocks of a checked number of bytes; each corpus
partition scores its vectors against a block with one matrix product (NumPy
over an Arrow batch), takes the k best of every query by partial selection
and emits only those; a final per-query top-k over those candidates is
exact, because every global top-k member is in its own partition's top-k.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import config
from quarry.session import materialize_table


def label_centroids(vecs: DataFrame, label: str = "label", emb: str = "embedding") -> DataFrame:
    """Mean vector per label (element-wise, via posexplode + groupBy)."""
    x = vecs.select(label, F.posexplode(emb).alias("pos", "v"))
    g = x.groupBy(label, "pos").agg(F.avg("v").alias("v"))
    return g.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_s")) \
        .select(F.col(label).alias("query_id"), F.transform("_s", lambda s: s["v"]).alias("qvec"))


#: Bytes of query vectors in one broadcast block.
BLOCK_BYTES = 32 << 20


def query_blocks(queries: DataFrame, limit: int = BLOCK_BYTES):
    """The queries in blocks of about `limit` bytes of vectors, one at the
    driver at a time.  The number of blocks comes from a sum of vector sizes;
    a hash of the id deals the queries out."""
    q = queries.select("query_id", "qvec")
    total = q.agg(F.sum(F.size("qvec") * 8 + 64)).first()[0] or 0
    n = total // limit + 1
    if n > 1:
        q = materialize_table(q.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(n))), "query-blocks")
    for b in range(n):
        block = (q if n == 1 else q.filter(F.col("_b") == b)).select("query_id", "qvec").collect()
        if block:
            yield block


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = config.TOP_K, id_col: str = "vec_id",
                emb: str = "embedding", where=None, min_score: float | None = None,
                block_bytes: int = BLOCK_BYTES, group: str | None = None) -> DataFrame:
    """V6: (query_id, id, score, rank) of the k most similar vectors; ties by
    id.  `where` filters the corpus first (V8 / V9); with `group` the top k
    is kept per (query, group), e.g. per collection (V7)."""
    spark = corpus.sparkSession
    c = corpus if where is None else corpus.filter(where)
    gcol = F.col(group).cast("string") if group else F.lit("")
    c = c.select(F.col(id_col).cast("long").alias("id"), F.col(emb).alias("v"), gcol.alias("grp"))
    kind = queries.schema["query_id"].dataType.simpleString()
    out_type = f"query_id {kind}, id long, score double, grp string"

    def best_of(block: list, batches):
        qids = np.array([r["query_id"] for r in block], dtype=object)
        qm = np.vstack([np.asarray(r["qvec"], dtype=np.float64) for r in block])
        qm = qm / np.maximum(np.linalg.norm(qm, axis=1, keepdims=True), 1e-300)
        best = None
        for pdf in batches:
            if pdf.empty:
                continue
            m = np.vstack([np.asarray(x, dtype=np.float64) for x in pdf["v"]])
            norms = np.linalg.norm(m, axis=1)
            scores = (m @ qm.T) / np.where(norms == 0, np.inf, norms)[:, None]
            for grp, rows in pdf.groupby("grp").indices.items():
                s = scores[rows]
                # the k-th best score of each query; what ties with it stays, ids decide below
                least = np.partition(s, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else np.full(s.shape[1], -np.inf)
                at, q = np.nonzero(s >= least)
                frame = pd.DataFrame({"query_id": qids[q], "id": pdf["id"].to_numpy()[rows[at]], "score": s[at, q], "grp": grp})
                if min_score is not None:
                    frame = frame[frame["score"] >= min_score]
                best = frame if best is None else pd.concat([best, frame])
            best = best.sort_values(["query_id", "grp", "score", "id"], ascending=[True, True, False, True]).groupby(["query_id", "grp"]).head(k)
        if best is not None:
            yield best

    out = None
    for block in query_blocks(queries, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        part = c.mapInPandas(lambda batches, sent=sent: best_of(sent.value, batches), out_type)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], out_type)
    w = Window.partitionBy("query_id", "grp").orderBy(F.col("score").desc(), F.col("id").asc())
    out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("id", id_col)
    return out.withColumnRenamed("grp", group) if group else out.drop("grp")


def merged_top(hits: DataFrame, n: int, id_col: str = "vec_id") -> DataFrame:
    """V7: per query the n best hits over all collections (score = 1 -
    cosine distance = cosine similarity)."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col).asc())
    return hits.withColumn("merged_rank", F.row_number().over(w)).filter(F.col("merged_rank") <= n)


def embed_text(corpus: DataFrame, others: list[DataFrame], text: str = "text", dim: int = 256):
    """V5: text -> L2-normalised hashed TF-IDF vector (MLlib HashingTF + IDF
    fitted on the corpus), as array<double> next to the ids.  Returns the
    embedded corpus and the other frames embedded with the same model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    pipe = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+", minTokenLength=2),
                            HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim),
                            IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_n")])
    model = pipe.fit(corpus)

    def emb(df):
        return model.transform(df).withColumn("embedding", vector_to_array("_n")).drop("_w", "_tf", "_idf", "_n")

    return emb(corpus), [emb(o) for o in others]


def hybrid_search(corpus: DataFrame, queries: DataFrame, keyword: str, k: int = config.TOP_K, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """V8: keyword filter (case-insensitive contains) on the corpus, then
    exact cosine top-k on the survivors."""
    return cosine_topk(corpus, queries, k=k, id_col=id_col, where=F.lower(F.col(text)).contains(keyword.lower()))
