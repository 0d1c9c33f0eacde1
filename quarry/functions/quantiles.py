"""Exact quantiles whose memory does not follow the data.

`percentile` keeps every distinct value of a column in one buffer, which for
a continuous column is every row.  Here the value at a rank is found by
narrowing: the range that holds the rank is cut into bins, one aggregate
counts them (with each bin's least and greatest value), and the bin with the
rank is the next range, until it holds a single value.  Each pass returns a
bounded number of rows and is shared by all columns and ranks.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import running_sums

BINS = 512


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles with linear interpolation; nulls and NaN
    do not count, infinite values stand at the ends; None where a column has
    no values."""
    inf = float("inf")
    v = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols}
    finite = {c: F.when((v[c] > -inf) & (v[c] < inf), v[c]) for c in cols}
    parts = (("n", lambda c: F.count(v[c])), ("low", lambda c: F.count_if(v[c] == -inf)), ("high", lambda c: F.count_if(v[c] == inf)),
             ("a", lambda c: F.min(finite[c])), ("b", lambda c: F.max(finite[c])))
    one = df.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(cols) for name, f in parts]).first()
    need = {c: [q * (one[f"n{i}"] - 1) for q in qs] if one[f"n{i}"] else [] for i, c in enumerate(cols)}

    def at_first(i: int, rank: int) -> tuple[float, float, int]:
        if rank < one[f"low{i}"]:
            return -inf, -inf, 0
        if rank >= one[f"n{i}"] - one[f"high{i}"]:
            return inf, inf, 0
        return one[f"a{i}"], one[f"b{i}"], one[f"low{i}"]

    # (column, rank) -> least value, greatest value, number of values before the least
    ranges = {(c, r): at_first(i, r) for i, c in enumerate(cols) for pos in need[c] for r in (math.floor(pos), math.ceil(pos))}
    while open_ := sorted({(c, a, b, past) for (c, _), (a, b, past) in ranges.items() if a < b}):
        def number(c, a, b):
            half = 0.5 if math.isinf(b - a) else 1.0  # the width itself must be finite
            return F.least(F.lit(BINS - 1), F.floor((v[c] * half - F.lit(a * half)) / F.lit(b * half - a * half) * BINS))

        cuts = F.array(*[F.when((v[c] >= F.lit(a)) & (v[c] <= F.lit(b)), F.struct(F.lit(k).alias("k"), number(c, a, b).alias("bin"), v[c].alias("v")))
                         for k, (c, a, b, _) in enumerate(open_)])
        rows = df.select(F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.bin").agg(
            F.count("*").alias("n"), F.min("x.v").alias("a"), F.max("x.v").alias("b")).collect()
        bins: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["k"], r["bin"])):
            bins.setdefault(r["k"], []).append(r)
        where = {key: k for k, key in enumerate(open_)}
        for (c, rank), (a, b, past) in list(ranges.items()):
            if a < b:
                for r in bins[where[c, a, b, past]]:
                    if rank < past + r["n"]:
                        ranges[c, rank] = (r["a"], r["b"], past)
                        break
                    past += r["n"]
    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = [(math.ceil(p) - p) * ranges[c, math.floor(p)][0] + (p - math.floor(p)) * ranges[c, math.ceil(p)][0] if p != math.floor(p)
                  else ranges[c, int(p)][0] for p in need[c]] or [None] * len(qs)
    return out


def group_quantiles(df: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float], prefix: str = "q") -> DataFrame:
    """(groups, q0, q1, ..) with linear interpolation for each group that has
    values; nulls and NaN do not count.

    The distinct (group, value) counts are summed range by range in their
    order; a group's ranks are those sums less what stands before the group.
    The values at the two ranks beside a quantile are then plain maxima, so
    neither a group nor its distinct values are gathered anywhere."""
    g = list(groups)
    v = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    h = df.select(*g, v.alias("_v")).where("_v IS NOT NULL").groupBy(*g, "_v").agg(F.count("*").alias("_c"))
    h = running_sums(h, [*g, "_v"], ["_c"])
    size = h.groupBy(*g).agg(F.sum("_c").alias("_n"), F.min("_c_before").alias("_first"))
    same = [F.col(f"h.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in g]
    x = h.alias("h").join(size.alias("s"), same) if g else h.crossJoin(size)
    x = x.select(*[F.col(f"h.`{c}`") if g else F.col(c) for c in g], "_v", "_n", (F.col("_c_before") - F.col("_first")).alias("_before"))
    parts = []
    for k, q in enumerate(qs):
        at = (F.col("_n") - 1) * q
        parts += [F.max(F.when(F.col("_before") <= F.floor(at), F.col("_v"))).alias(f"_lo{k}"), F.max(F.when(F.col("_before") <= F.ceil(at), F.col("_v"))).alias(f"_hi{k}"),
                  F.max(at - F.floor(at)).alias(f"_w{k}")]
    x = x.groupBy(*g).agg(*parts)
    return x.select(*g, *[F.when(F.col(f"_w{k}") == 0, F.col(f"_lo{k}")).otherwise(F.col(f"_lo{k}") * (1 - F.col(f"_w{k}")) + F.col(f"_hi{k}") * F.col(f"_w{k}")).alias(f"{prefix}{k}") for k in range(len(qs))])
