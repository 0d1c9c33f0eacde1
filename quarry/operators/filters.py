"""Filters, searches and ordered lists (F1, F3, F4, F7, F8, F10, O1, O4,
O5, O9-O11).  Predicates are composed into one filter so Catalyst pushes
what it can into the scan; ordered lists are top-N (TakeOrderedAndProject)
only where the report is a top-N list."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import ntz_lit


def where_all(df: DataFrame, **conds) -> DataFrame:
    """Equality, IN-list (list/tuple values), (lo, hi) ranges
    given as `col__between=(lo, hi)`, booleans."""
    cond = F.lit(True)
    for k, v in conds.items():
        if k.endswith("__between"):
            cond = cond & F.col(k[:-9]).between(v[0], v[1])
        elif isinstance(v, (list, tuple, set)):
            cond = cond & F.col(k).isin(list(v))
        else:
            cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def recent(df: DataFrame, ts: str, as_of, hours: int) -> DataFrame:
    """rows in the last `hours` before as_of."""
    now = ntz_lit(as_of)
    return df.filter((F.col(ts) >= now - F.make_interval(hours=F.lit(hours))) & (F.col(ts) < now))


def high_priority(issues: DataFrame, n: int = 50) -> DataFrame:
    """F8: high / critical tier or more than three issues, by score."""
    x = issues.filter(F.col("priority_tier").isin("critical", "high") | (F.col("total_issues") > 3))
    return x.orderBy(F.col("priority_score").desc(), F.col("patient_key").asc()).limit(n)


def mapped_order(df: DataFrame, col: str, order: Sequence[str], then: Column, key: str, n: int) -> DataFrame:
    """Sort by a mapped order of a label, then a score."""
    pos = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return df.orderBy(F.coalesce(pos[F.col(col)], F.lit(len(order))), then, F.col(key).asc()).limit(n)


def top_sites_for(issues: DataFrame, issue_type: str, n: int = 10) -> DataFrame:
    """Sites with the most of one issue type."""
    s = issues.groupBy("study_id", "site_id").agg(F.sum(f"count_{issue_type}").alias("issue_count"))
    return s.orderBy(F.col("issue_count").desc(), "study_id", "site_id").limit(n)


def opportunities(issue_rows: DataFrame, weights: dict, n: int = 20) -> DataFrame:
    """(site, issue type) by impact = count x weight, top n."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    s = issue_rows.groupBy("site_id", "issue_type").agg(F.sum("issue_count").alias("issue_count"),
                                                        F.count(F.lit(1)).alias("patients"))
    s = s.withColumn("impact", F.col("issue_count") * F.coalesce(w[F.col("issue_type")], F.lit(1.0)))
    return s.orderBy(F.col("impact").desc(), "site_id", "issue_type").limit(n)


def prefix_suggestions(docs: DataFrame, prefix: str, n: int = 10, text: str = "text") -> DataFrame:
    """Words starting with a prefix by usage, top n."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), 0)).alias("word"))
    c = w.filter(F.col("word").startswith(prefix)).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return c.orderBy(F.col("uses").desc(), F.col("word").asc()).limit(n)


def pinned_first(df: DataFrame, pinned: Column, ts: str, key: str, n: int) -> DataFrame:
    """Pinned rows first, then newest."""
    return df.orderBy(pinned.desc(), F.col(ts).desc(), F.col(key).asc()).limit(n)


def audit_query(entries: DataFrame, flagged: DataFrame, actors: Sequence[int], types: Sequence[str], start, end) -> DataFrame:
    """audit entries matching several predicates that also appear in a
    flag table (left semi join), distinct actors and types."""
    x = entries.filter(F.col("actor_id").isin(list(actors)) & F.col("event_type").isin(list(types))
                       & (F.col("timestamp") >= ntz_lit(start)) & (F.col("timestamp") < ntz_lit(end)))
    return x.join(flagged, "entry_id", "left_semi").select("actor_id", "event_type").distinct()


#: The optional predicates of an audit search and what they compare.
AUDIT_EQUAL = ("actor_id", "event_type", "action_category", "entity_type", "entity_id", "severity", "success", "correlation_id")


def audit_search(entries: DataFrame, flags: DataFrame | None = None, tags: DataFrame | None = None, *, start=None, end=None, flag: str | None = None,
                 tag: str | None = None, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    """a page of the audit entries that meet every criterion given, newest
    first (ties: entry_id): equality on `AUDIT_EQUAL`, a time range (both ends
    in), a compliance flag (entry_id, flag) and a tag (entry_id, tag).  Flags
    and tags are semi joins, so an entry with many counts once.  `total` is the
    number of entries on all pages."""
    if unknown := set(equal) - set(AUDIT_EQUAL):
        raise ValueError(f"no such criteria: {sorted(unknown)}")
    x = entries
    for c, v in equal.items():
        if v is not None:
            x = x.where(F.col(c) == F.lit(v))
    if start is not None:
        x = x.where(F.col("timestamp") >= ntz_lit(start))
    if end is not None:
        x = x.where(F.col("timestamp") <= ntz_lit(end))
    if flag is not None:
        x = x.join(flags.where(F.col("flag") == flag).select("entry_id"), "entry_id", "left_semi")
    if tag is not None:
        x = x.join(tags.where(F.col("tag") == tag).select("entry_id"), "entry_id", "left_semi")
    x = x.distinct()
    total = x.agg(F.count("*").alias("total"))
    page = x.orderBy(F.desc("timestamp"), "entry_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))
