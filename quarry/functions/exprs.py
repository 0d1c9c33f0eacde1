"""Reusable Column builders.

All helpers return `Column`s made of built-in functions, so whole-stage
codegen stays intact; no Python runs per row.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = [
    "col_or_lit", "safe_ratio", "clip", "band", "pct_rank_avg", "first_true",
    "fold_and", "fold_or", "top_n_text", "num", "zero_if_null", "argmax_name", "epoch_micros", "ntz_lit",
    "count_where", "sum_where", "entity_key", "lenient_double", "round_half_even",
    "greatest_ordinal_label", "stack_columns",
]


def col_or_lit(df: DataFrame, name: str, default=0.0) -> Column:
    """Column `name` if the frame has it, else a literal (resolved at plan time)."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def num(c: str | Column, default: float = 0.0) -> Column:
    """Null-safe double: null/NaN -> default."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(default)))


def zero_if_null(c: str | Column) -> Column:
    return num(c, 0.0)


def safe_ratio(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d when d > 0 else default."""
    return F.when(d > 0, n / d).otherwise(F.lit(float(default)))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return c


def band(c: Column, edges: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First (threshold, label) with c >= threshold wins, else `otherwise`.

    NaN and null compare false everywhere and fall to `otherwise`, the same
    way a chain of `>=` tests behaves in Python.
    """
    guarded = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
    expr = None
    for thr, label in edges:
        cond = guarded >= F.lit(thr)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise)) if expr is not None else F.lit(otherwise)


def pct_rank_avg(value: Column, partition: Sequence[str | Column] | None, ascending: bool = True) -> Column:
    """Average-method rank divided by group size (pandas `rank(pct=True)`).

    rank_min + (ties - 1) / 2, over the group count.  Null values get null.
    """
    value = F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)  # NaN is missing, as in pandas
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    part = list(partition or [])
    w_order = Window.partitionBy(*part).orderBy(order)
    w_ties = Window.partitionBy(*part, value)
    w_all = Window.partitionBy(*part)
    n = F.count(value).over(w_all)
    r = F.rank().over(w_order) + (F.count(F.lit(1)).over(w_ties) - 1) / 2.0
    return F.when(value.isNull(), F.lit(None).cast("double")).otherwise(r / n)


def first_true(pairs: Sequence[tuple[Column, str]], otherwise=None) -> Column:
    """Label of the first condition that holds (ordered `when` chain)."""
    expr = None
    for cond, label in pairs:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(otherwise)
    return expr.otherwise(F.lit(otherwise))


def fold_and(cols: Iterable[Column]) -> Column:
    out = None
    for c in cols:
        out = c if out is None else (out & c)
    return out if out is not None else F.lit(True)


def fold_or(cols: Iterable[Column]) -> Column:
    out = None
    for c in cols:
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def count_where(cond: Column) -> Column:
    """count of rows where cond holds (0 when none; never null)."""
    return F.count(F.when(cond, F.lit(1)))


def sum_where(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value))


def entity_key(*cols: str | Column, unknown: str = "Unknown") -> Column:
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(unknown)) for c in cols]
    return F.concat_ws("|", *parts)


def lenient_double(c: str | Column, default: float | None = None) -> Column:
    """`to_numeric(errors='coerce')`, then optional fill."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.trim(c.cast("string")).try_cast("double")
    return out if default is None else F.coalesce(out, F.lit(float(default)))


_EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a date / datetime / string, built from its
    text so neither the Python process nor the session time zone shifts it."""
    import datetime as _dt
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def epoch_micros(c: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (or TIMESTAMP) value,
    independent of the session time zone: differences of wall-clock
    timestamps stay exact across daylight-saving changes."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def round_half_even(c: Column, scale: int) -> Column:
    """Half-even rounding done in decimal arithmetic.

    The double is first taken to its decimal value, then rounded half to
    even; binary artefacts (36.025 stored as 36.02499...) cannot tip a tie
    one way in one engine and the other way in another.
    """
    return F.bround(c.cast("decimal(38,12)"), scale).cast("double")


def argmax_name(values: Sequence[tuple[str, Column]], min_value: float | None = None,
                none_label: str | None = None) -> Column:
    """Name of the largest value; first declared wins ties.

    Encoded as max over structs (value, -ordinal, name): a larger value wins,
    and among equal values the smaller ordinal wins.
    """
    structs = [
        F.struct(v.cast("double").alias("v"), F.lit(-i).alias("o"), F.lit(name).alias("n"))
        for i, (name, v) in enumerate(values)
    ]
    best = F.greatest(*structs) if len(structs) > 1 else structs[0]
    if min_value is None:
        return best["n"]
    return F.when(best["v"] > F.lit(min_value), best["n"]).otherwise(F.lit(none_label))


def greatest_ordinal_label(ordinals: Sequence[Column], labels: Sequence[str]) -> Column:
    """Max ordinal mapped back to its label (labels indexed by ordinal)."""
    g = F.greatest(*ordinals) if len(ordinals) > 1 else ordinals[0]
    return F.get(F.array(*[F.lit(x) for x in labels]), g)


def top_n_text(items: Sequence[tuple[str, Column]], n: int, sep: str = "; ",
               fmt: str = "{name}:{value}") -> Column:
    """'name:count' of the n largest positive values, joined by sep.

    Ties keep the declared order (sort key = (-value, ordinal)).
    """
    arr = F.array(*[
        F.struct((-v.cast("double")).alias("k"), F.lit(i).alias("o"), F.lit(name).alias("n"),
                 v.cast("double").alias("v"))
        for i, (name, v) in enumerate(items)
    ])
    pos = F.filter(F.array_sort(arr), lambda s: s["v"] > 0)
    top = F.slice(pos, 1, n)
    if fmt == "{name}:{value}":
        txt = F.transform(top, lambda s: F.concat(s["n"], F.lit(":"), s["v"].cast("long").cast("string")))
    else:
        txt = F.transform(top, lambda s: s["n"])
    return F.array_join(txt, sep)


def stack_columns(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name_col: str,
                  value_col: str, value_type: str = "double") -> DataFrame:
    """Unpivot `cols` into (name_col, value_col) rows."""
    return df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name_col, value_col)
