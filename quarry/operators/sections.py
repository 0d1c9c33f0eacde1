"""Sections of texts by their headings, and what tables say of an entity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.textops import chunk_texts

LEVELS = 6
LONG = 1.5  # chunks' size over which a section is cut
MARKED, NUMBERED, CAPITALS = r"^#{1,6}\s+\S.*$", r"^\d+(?:\.\d+)*[.)]?\s+[A-Z].*$", r"^[A-Z][A-Z\s()-]{5,}:?\s*$"


def heading_level(line: Column) -> Column:
    """1 for a line in capitals, the number of # or of numbers in front of a
    title otherwise (the deepest counts for all below); null for other lines."""
    deep = (F.when(line.rlike(MARKED), F.length(F.regexp_extract(line, "^#+", 0)))
            .when(line.rlike(NUMBERED), F.size(F.split(F.regexp_extract(line, r"^\d+(?:\.\d+)*", 0), r"\."))).when(line.rlike(CAPITALS), 1))
    return F.when(deep > LEVELS, LEVELS).otherwise(deep)


def title_of(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(line, r"^(?:#{1,6}|\d+(?:\.\d+)*[.)]?)\s+", "")), r":$", "")


def sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """V3: (id, section, level, title, path, from, to, text) of every document
    (ids are distinct; null and empty texts have no sections).

    A section runs from its heading to the next; what stands before the first
    heading is section 0 without one.  `path` holds the titles of the headings
    it stands under and its own: of each level the last one, if no heading of
    a lesser level came after it.  The sections' texts, joined by line feeds,
    are the document."""
    lines = docs.where(F.length(text) > 0).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "t"))
    in_order = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("level", heading_level(F.col("t")))
    lines = lines.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(in_order)).withColumn("end", F.sum(F.length("t") + 1).over(in_order))
    x = lines.groupBy("id", "section").agg(
        F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), title_of(F.col("t")))).alias("title"), F.min(F.col("end") - F.length("t") - 1).alias("from"),
        (F.max("end") - 1).alias("to"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda r: r["t"]), "\n").alias("text"))
    so_far = Window.partitionBy("id").orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({f"_{k}": F.last(F.when(F.col("level") == k, F.struct("section", "title")), ignorenulls=True).over(so_far) for k in range(1, LEVELS + 1)})

    def under(k: int) -> Column:
        stands = F.col("level") >= k
        for j in range(1, k):
            stands = stands & (F.coalesce(F.col(f"_{j}.section"), F.lit(-1)) < F.col(f"_{k}.section"))
        return F.when(stands, F.col(f"_{k}.title"))

    path = F.array_compact(F.array(*[under(k) for k in range(1, LEVELS + 1)]))
    return x.select(F.col("id").alias(id_col), "section", "level", "title", path.alias("path"), "from", "to", "text")


def section_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 500) -> DataFrame:
    """V3: sections as chunks, long ones cut as texts are (V2)."""
    s = sections(docs, id_col, text)
    whole = F.array(F.col("text"))
    long = F.length("text") > size * LONG
    parts = F.when(long, chunk_texts(F.when(long, F.col("text")))).otherwise(whole)  # others do not leave the JVM
    return s.select(id_col, "section", "path", F.posexplode(parts).alias("chunk_index", "chunk")).select(
        id_col, "section", "path", "chunk_index", "chunk", F.length("chunk").alias("char_count"))


def entity_context(fragments: dict[str, DataFrame], best: int = 5) -> DataFrame:
    """(entity, fragments, kinds, context) from tables of fragments
    (entity, rank, text): of each kind the `best` by rank (then text), with how
    many there are, in the order of the kinds given.

    All tables become one with the kind as a tag, so there is one grouping for
    all of them in place of a join for each.  Only the best of a task's rows
    leave it, and counts are summed before they do: an entity with most of all
    rows costs no more than another."""
    tagged = None
    for i, (kind, df) in enumerate(fragments.items()):
        part = df.select("entity", F.lit(i).alias("nth"), F.lit(kind).alias("kind"), F.col("rank").cast("double").alias("rank"), "text")
        tagged = part if tagged is None else tagged.unionByName(part)
    key = ["entity", "nth", "kind"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("rank"), "text"))
    top = tagged.withColumn("_place", place).where(F.col("_place") <= best)
    top = top.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "text"))), lambda r: r["text"]), "; ").alias("texts"))
    x = tagged.groupBy(*key).agg(F.count("*").alias("n")).join(top, key)
    said = F.transform(F.sort_array(F.collect_list(F.struct("nth", "kind", "n", "texts"))), lambda r: F.concat(r["kind"], F.lit(" ("), r["n"].cast("string"), F.lit("): "), r["texts"]))
    return x.groupBy("entity").agg(F.sum("n").alias("fragments"), F.count("*").alias("kinds"), F.array_join(said, "\n").alias("context"))
