"""The registered queries of the package and their SQL."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.session import ensure_checkpoint_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_bitplane_tokens")
def op2_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.bitplane import read_digests, write_token_files

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex[:12]}"
    write_token_files(table(spark, sf_dir, "documents"), folder, _tokenizer("byte_bpe_50k.json"), added_tokens=True)
    return read_digests(spark, folder)


@query("op8_bpe_merge_replay")
def op8_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quarry.llm.bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_simhash_bit_sliced")
def op5_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


WORDS_SQL = r"list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op10_aho_decontamination", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM (SELECT doc_id, coalesce({LOWER_SQL}, '') AS lower_ascii FROM documents)),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM (SELECT item_id, {LOWER_SQL} AS lower_ascii FROM benchmark WHERE text IS NOT NULL)),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
        FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM d, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.win = win.win AND pos.n = win.n),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(per.n_hit, 0) AS n_hit, coalesce(ids.n_items, 0) AS n_items,
       sha256(coalesce(ids.ids, '')) AS items_sha256, per.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN ids USING (doc_id)""")
def op10_aho_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontam import decontaminated

    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_secret_lexing")
def op4_secret_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op1_attention_mil")
def op1_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_order_minhash")
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.orderhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query("op3_vector_bin_packing")
def op3_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.binpack import assign

    return assign(table(spark, sf_dir, "documents"))


@query("op9_perspective_rotation", """
WITH t AS (SELECT conv_id, turn, replace(coalesce(nullif(trim(translate(trim(role), chr(13) || chr(10), '  ')), ''), 'unknown'), '<|im_', '<' || chr(8203) || '|im_') AS speaker,
             replace(coalesce(text, ''), '<|im_', '<' || chr(8203) || '|im_') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
v AS (SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.text, t.speaker = p.perspective AS learnt,
             CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role,
             CASE WHEN t.speaker NOT IN ('system', p.perspective) THEN t.speaker END AS name
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM v),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM s),
o AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w - length(segment) AS start FROM g
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, role, name, segment, CAST(start AS BIGINT) AS start, CAST(start + length(segment) AS BIGINT) AS "end", learnt,
       CAST(CASE WHEN learnt THEN start + length(head) END AS BIGINT) AS learnt_start, CAST(CASE WHEN learnt THEN start + length(segment) - 1 END AS BIGINT) AS learnt_end
FROM o""")
def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.perspectives import rotate

    return rotate(table(spark, sf_dir, "conversations"))


@query("op7_html_text_blocks")
def op7_html_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op11_pii_spans")
def op11_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.repair import report

    return report(table(spark, sf_dir, "conversations"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.variants import groups

    return groups(table(spark, sf_dir, "documents"))
