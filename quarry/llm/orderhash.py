"""Document fingerprints by Order MinHash, in DataFrame functions only.

K-mers are runs of `KMER` words, numbered by occurrence, so that the second
"of the" of a text is an item of its own.  Each item is hashed once; the
leading bits deal the items into bins, and the least item of each bin is
selected.  The selected items of `TUPLE` neighbouring bins are put back into
the order of the text and hashed together: one slot of the signature.  Moving
text changes slots even where the set of k-mers stays, so equal slots speak
for a small edit distance, not only for shared words.

An item is one long: its hash in the upper 33 bits, its position in the lower
31.  Sorting a text's items therefore groups equal k-mers in text order and
lines up the bins, without exploding the text into rows.  Each array is a
column that the next expression uses more than once, so Catalyst keeps it as
a projection of its own and evaluates it once.

Defined results: a null text counts as empty, and an empty text is one empty
word; equal texts have equal fingerprints; repeated rows repeat; an empty
table gives an empty one; the document after the last is the first; ties in
doc_id go by the hash of the text, a null doc_id comes last; other columns
are left behind.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KMER = 2
TUPLE = 2
SLOT_BITS = 6
#: Documents in one range of doc_ids, and ranges at most (their borders are a literal of the plan).
RANGE_ROWS = 2000
MAX_RANGES = 4096

_POSITION = (1 << 31) - 1
_HASH = ~_POSITION


def _hash(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_HASH).cast("bigint"))


def _top(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, 64 - bits)


def with_signature(df: DataFrame, text: str, to: str, kmer: int = KMER, slot_bits: int = SLOT_BITS) -> DataFrame:
    """Add `to`: an array of integers, slot * 65536 + 16 bits of the slot's
    hash, for every slot that has an item."""
    names = df.columns
    bin_bits = slot_bits + 1  # TUPLE bins to a slot
    words, items, again, starts, least = (f"_{to}_{x}" for x in ("words", "items", "again", "starts", "least"))

    def item(hashed: Column, position: Column) -> Column:
        return _hash(hashed).bitwiseOR(position.cast("bigint"))

    df = df.withColumn(words, F.split(F.col(text), r"\s+"))
    df = df.withColumn(items, F.sort_array(F.transform(words, lambda w, i: item(
        F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, kmer)]), i))))
    # what has an equal k-mer before it
    df = df.withColumn(again, F.filter(items, lambda x, i: (i > 0) & (_hash(x) == _hash(F.get(F.col(items), i - 1)))))
    df = df.withColumn(starts, F.filter(F.transform(again, lambda x, i: F.when((i > 0) & (_hash(x) == _hash(F.get(F.col(again), i - 1))), F.lit(-1)).otherwise(i)), lambda i: i >= 0))
    number = F.flatten(F.transform(starts, lambda s, j: F.sequence(F.lit(1), F.coalesce(F.get(F.col(starts), j + 1), F.size(again)) - s)))
    numbered = F.zip_with(again, number, lambda x, n: item(F.xxhash64(_hash(x), n), x.bitwiseAND(F.lit(_POSITION))))
    df = df.withColumn(items + "2", F.sort_array(F.concat(F.col(items), numbered)))
    items += "2"
    df = df.withColumn(least, F.filter(items, lambda x, i: (i == 0) | (_top(x, bin_bits) != _top(F.get(F.col(items), i - 1), bin_bits))))

    def slot(x: Column, i: Column) -> Column:
        """The slot that begins at this item, or -1 if it began before."""
        other = F.get(F.col(least), i + 1)
        both = _top(other, slot_bits) == _top(x, slot_bits)
        first = x.bitwiseAND(F.lit(_POSITION)) <= other.bitwiseAND(F.lit(_POSITION))
        hashed = F.when(both & first, F.xxhash64(_hash(x), _hash(other))).when(both, F.xxhash64(_hash(other), _hash(x))).otherwise(F.xxhash64(_hash(x)))
        began = (i > 0) & (_top(F.get(F.col(least), i - 1), slot_bits) == _top(x, slot_bits))
        code = _top(x, slot_bits) * 65536 + hashed.bitwiseAND(F.lit(65535))
        return F.when(began, F.lit(-1)).otherwise(code.cast("int"))

    df = df.withColumn(to, F.filter(F.transform(least, slot), lambda c: c >= 0))
    return df.select(*names, to)


def fingerprint(signature: str) -> Column:
    """The signature as text: two digits of slot and four of hash each."""
    return F.array_join(F.transform(signature, lambda c: F.lower(F.lpad(F.hex(c), 6, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Equal slots among the slots that either has."""
    slots = F.size(F.array_union(F.transform(a, lambda c: F.shiftright(c, 16)), F.transform(b, lambda c: F.shiftright(c, 16))))
    return F.when(slots == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / slots)


def _literal(values: list[int]) -> Column:
    # the least long has no literal of its own
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")") if values else F.expr("CAST(array() AS array<bigint>)")


def with_next(df: DataFrame, order: str, tie: str, carry: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: its value in the row after, by
    `order` descending and `tie` descending; after the last row, the first's.

    Rows are dealt into ranges of `order`; a range's first row is also put
    behind the last of the range above it (and the first of all behind the
    last of all), so every range finds its rows' successors by itself.
    """
    n = df.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    borders = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 and n else []
    borders = sorted(set(borders or []))
    edge = _literal(borders)
    df = df.withColumn("_range", F.size(F.filter(edge, lambda b: b < F.col(order))) if borders else F.lit(0))
    tops = {r["_range"]: (r["top"][order], r["top"][tie]) for r in df.groupBy("_range").agg(F.max(F.struct(order, tie)).alias("top")).collect()}
    filled = sorted(tops)
    above = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    spread = range(max(filled, default=0) + 1)
    first_order, first_tie, target = (_literal([f(r) for r in spread]) for f in (lambda r: tops.get(r, (0, 0))[0], lambda r: tops.get(r, (0, 0))[1], lambda r: above.get(r, 0)))
    own = F.struct(F.col("_range").cast("bigint").alias("at"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.get(target, F.col("_range")).alias("at"), F.lit(True).alias("ghost"))
    top = (F.col(order) == F.get(first_order, F.col("_range"))) & (F.col(tie) == F.get(first_tie, F.col("_range")))
    names = [c for c in df.columns if c != "_range"]
    dealt = df.select(*names, F.explode(F.when(top, F.array(own, ghost)).otherwise(F.array(own))).alias("_to"))
    inside = Window.partitionBy("_to.at").orderBy("_to.ghost", F.desc(order), F.desc(tie))
    return (dealt.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carry])
            .where(~F.col("_to.ghost")).drop("_to"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with the likeness of
    the text to that form and to the next document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("_order", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint"))).withColumn("_tie", F.xxhash64("text"))
    rows = with_signature(rows, "text", "own")
    rows = with_next(rows, "_order", "_tie", ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "own", "next_own", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = with_signature(rows, "edited", "changed")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
                       likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
