"""Similar sets and term lookup without comparing everything with everything:
transfers of patterns between studies (X3, W16, V12) and dictionary search (V15).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize_table

#: What agreement in type, issue types (Jaccard) and severity counts.
TYPE, ISSUES, SEVERITY = 0.4, 0.3, 0.2
SIMILARITY, CONFIDENCE, BEST = 0.7, 0.6, 5
SEVERITY_SCORES = {"Critical": 1.0, "High": 0.75, "Medium": 0.5, "Low": 0.25}
#: Code points up to which a needle is few, and up to which it is its own key.
SHORT, GRAM = 5, 16
SLICE = 256


# similar sets


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard), a < b, of all pairs of rows (id, part, tokens) of one
    part whose Jaccard similarity reaches `least` > 0.  Tokens are distinct.

    Tokens are ordered by how rare they are.  Two sets that are similar enough
    share a token among their first n - ceil(least * n) + 1, and neither is
    shorter than `least` times the other; only such pairs are compared, each
    under the first token that they share.  What stands behind that token and
    64 bits of each set bound their shared members before these are looked up.
    The sets under a token are cut into slices of about `SLICE`, each of which
    meets all of them, so a token that most sets have is the work of many tasks."""
    if least <= 0:
        raise ValueError("without a least similarity every pair qualifies")
    rare = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    ordered = sets.select("id", "part", F.explode("tokens").alias("token")).join(rare, "token").groupBy("id", "part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("c", "token"))), lambda x: x["token"]).alias("tokens"))
    n = F.size("tokens")
    bits = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))))
    ordered = materialize_table(ordered.select("id", "part", "tokens", n.alias("n"), bits.alias("bits")), "set-order")
    # a share of n a hair above a whole number is that number
    first = F.slice("tokens", F.lit(1), (n - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    # a struct equals another with a null at the same place
    index = materialize_table(ordered.select(F.struct("part").alias("part"), F.posexplode(first).alias("at", "token"), "id", "n", "bits", "tokens"), "set-index")
    sizes = index.groupBy("part", "token").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    index = index.join(sizes, ["part", "token"])
    spark = sets.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    deal = lambda df: df.repartition(tasks, "part", "token", "slice")
    x = deal(index.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))).alias("x")
    y = deal(index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))).alias("y")
    both = F.col("x.n") + F.col("y.n")
    enough = both * (least / (1 + least)) - 1e-9  # shared members at the least
    behind = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    apart = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))  # no fewer members are in one set only
    shared = F.array_intersect("x.tokens", "y.tokens")
    near = ((F.col("x.part") == F.col("y.part")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.id") < F.col("y.id"))
            & (F.col("x.n") >= F.col("y.n") * least - 1e-9) & (F.col("y.n") >= F.col("x.n") * least - 1e-9)
            & (behind >= enough) & (both - apart >= 2 * enough))
    # exploded, so that it is computed once a pair and stays out of the join's condition
    pairs = x.join(y.hint("merge"), near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.token").alias("token"), both.alias("both"), F.explode(F.array(shared)).alias("shared"))
    pairs = pairs.where(F.get("shared", F.lit(0)) == F.col("token"))
    return pairs.select("a", "b", (F.size("shared") / (F.col("both") - F.size("shared"))).alias("jaccard")).where(F.col("jaccard") >= least - 1e-9)


def transfer_matches(items: DataFrame, similarity: float = SIMILARITY, best: int = BEST) -> DataFrame:
    """For each study the `best` matches of its items with items of other
    studies, by confidence (ties: the source's own, the target's own, source,
    target).  items: (item, study, type,
    severity, tokens, confidence), ids as text.

    The similarity of two items hangs on their type, severity and tokens
    alone, so equal ones form a class, and classes are compared.  Only a
    class's best items can be among a study's best matches: `best` of each
    study as targets, and as sources the 2 * best of those that come first, of
    which at least `best` are of another study.

    Matches inside classes are found first.  The last of a study's best ones is
    a bar for all others, so different classes are compared, and their items
    joined, only where their most confident items could still reach it."""
    if similarity <= ISSUES + SEVERITY:
        raise ValueError("items of different types would match")
    items = items.withColumn("tokens", F.sort_array("tokens")).withColumn("cls", F.md5(F.concat_ws("\x01", "type", "severity", F.array_join("tokens", "\x02"))))
    items = materialize_table(items, "transfer-items")
    top = F.max(F.coalesce("confidence", F.lit(float("inf"))))  # a null is no bound
    classes = materialize_table(items.groupBy("cls").agg(F.first("type").alias("type"), F.first("severity").alias("severity"), F.first("tokens").alias("tokens"), F.count("*").alias("affected"), top.alias("top")), "transfer-classes")
    order = [F.desc("confidence"), F.asc("item")]
    targets = materialize_table(items.withColumn("_n", F.row_number().over(Window.partitionBy("cls", "study").orderBy(*order))).where(F.col("_n") <= best), "transfer-targets")
    sources = materialize_table(targets.withColumn("_n", F.row_number().over(Window.partitionBy("cls").orderBy(*order))).where(F.col("_n") <= 2 * best), "transfer-sources")
    s = sources.select(F.col("cls").alias("a"), F.col("item").alias("source"), F.col("study").alias("source_study"), F.col("confidence").alias("_s"), F.col("type").alias("pattern_type"), F.col("severity").alias("source_severity"))
    t = targets.select(F.col("cls").alias("b"), F.col("item").alias("target"), F.col("study").alias("target_study"), F.col("confidence").alias("_t"), F.col("severity").alias("target_severity"))
    ranked = Window.partitionBy("target_study").orderBy(F.desc("confidence"), F.desc("_s"), F.desc("_t"), "source", "target")

    def best_of(pairs: DataFrame, on: list[str]) -> DataFrame:
        x = pairs.join(s, "a").join(t, on).where(F.col("source_study") != F.col("target_study"))
        x = x.withColumn("confidence", F.least("_s", "_t") * F.col("similarity"))
        return x.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= best)

    same = classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), (F.lit(TYPE) + ISSUES * F.when(F.size("tokens") > 0, 1.0).otherwise(0.0) + SEVERITY).alias("similarity"))
    inside = materialize_table(best_of(same.where(F.col("similarity") >= similarity), ["b"]), "transfer-inside")
    bar = F.max(F.when(F.col("place") == best, F.col("confidence")))
    bars = targets.select(F.col("study").alias("target_study")).distinct().where("target_study IS NOT NULL").join(inside.groupBy("target_study").agg(bar.alias("bar")), "target_study", "left")
    bars = materialize_table(bars.select("target_study", F.coalesce("bar", F.lit(float("-inf"))).alias("bar")), "transfer-bars")  # a row a study
    reach = lambda c, most: F.greatest(c * most, c * similarity) + 1e-9
    n = F.size("tokens")
    most = F.lit(TYPE + SEVERITY) + ISSUES * n / (n + 1)  # the nearest other set has one more
    other = F.greatest(most, F.lit(TYPE + ISSUES))  # or the same under another severity
    able = classes.crossJoin(bars.agg(F.min("bar").alias("least"))).where(reach(F.col("top"), other) >= F.col("least"))
    able = materialize_table(able, "transfer-able")
    least = lambda rest: max(similarity - TYPE - rest, 1e-6) / ISSUES
    # of one severity, then of different ones
    pairs = similar_sets(able.select(F.col("cls").alias("id"), F.to_json(F.struct("type", "severity")).alias("part"), "tokens"), least(SEVERITY))
    if least(0) >= 1 - 1e-9:  # equal sets alone
        x, y = (able.where(n > 0).select(F.struct("type", "tokens").alias("set"), F.col("cls").alias(c)) for c in "ab")
        cross = x.join(y, "set").where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    else:
        cross = similar_sets(able.select(F.col("cls").alias("id"), F.col("type").alias("part"), "tokens"), least(0))
    of = lambda side: able.select(F.col("cls").alias(side), F.col("severity").alias(f"severity_{side}"))
    known = lambda p: p.join(of("a"), "a").join(of("b"), "b")
    alike = F.coalesce(F.col("severity_a") == F.col("severity_b"), F.lit(False))
    pairs = known(pairs).where(alike).unionByName(known(cross).where(~alike))
    score = F.lit(TYPE) + ISSUES * F.col("jaccard") + F.when(alike, SEVERITY).otherwise(0.0)
    pairs = pairs.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= similarity)
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    tops = targets.groupBy(F.col("cls").alias("b"), F.col("study").alias("target_study")).agg(top.alias("_b")).join(F.broadcast(bars), "target_study")
    near = pairs.join(able.select(F.col("cls").alias("a"), F.col("top").alias("_a")), "a").join(tops, "b")
    near = near.where(F.least("_a", "_b") * F.col("similarity") + 1e-9 >= F.col("bar")).select("a", "b", "target_study", "similarity")
    outside = best_of(near, ["b", "target_study"])
    x = inside.unionByName(outside).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= best)
    kind = F.when(F.col("similarity") >= 0.95, "exact").when(F.col("similarity") >= 0.85, "similar").otherwise("related")
    return x.join(classes.select(F.col("cls").alias("a"), "affected"), "a").select(
        "target_study", "place", "source_study", "source", "target", "pattern_type", "source_severity", "target_severity", "similarity", kind.alias("match_type"), "confidence", "affected")


def transfer_recommendations(matches: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """The matches sure enough to act on, with a priority from confidence,
    severity and how many items the source's class holds, and whether the
    severities are two or more steps apart."""
    steps = F.create_map(*[x for i, k in enumerate(reversed(SEVERITY_SCORES)) for x in (F.lit(k), F.lit(i))])
    worth = F.create_map(*[x for k, v in SEVERITY_SCORES.items() for x in (F.lit(k), F.lit(v))])
    many = F.when(F.col("affected") >= 100, 0.3).when(F.col("affected") >= 50, 0.2).when(F.col("affected") >= 20, 0.1).otherwise(0.0)
    score = F.col("confidence") * 0.4 + F.coalesce(worth[F.col("source_severity")], F.lit(0.5)) * 0.3 + many
    step = lambda c: F.coalesce(steps[F.col(c)], F.lit(1))
    return matches.where(F.col("confidence") >= least).select(
        "*", F.when(score >= 0.8, "Critical").when(score >= 0.6, "High").when(score >= 0.4, "Medium").otherwise("Low").alias("priority"),
        (F.abs(step("source_severity") - step("target_severity")) > 1).alias("severity_calibration"))


# dictionary search


def _runs(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of as many code points as each of `sizes` says."""
    n = F.length(text)
    fit = F.filter(F.array(*map(F.lit, sizes)), lambda size: size <= n)
    return F.array_distinct(F.flatten(F.transform(fit, lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size)))))


def _holding(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, hay) ids of all pairs of texts (id, text) where the second holds
    the first.

    Up to `GRAM` code points a needle is itself the key: the hay's runs of the
    needles' lengths are joined with it, so only what holds it is ever paired,
    and rows grow with the hay's length alone.  Short needles, which as a rule
    are few, make a table of their own that Spark can broadcast.  A longer
    needle is looked up under the rarest of its runs of `GRAM`, and what is
    found there is compared.  Empty texts hold nothing and are held by nothing."""
    spark = hay.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    hay = hay.select(F.col("id").alias("hay"), "text").repartition(tasks, "hay")  # few bytes, many runs
    needles = needles.select(F.col("id").alias("needle"), F.col("text").alias("needle_text"))
    n = F.length("needle_text")
    found = needles.select("needle").limit(0).crossJoin(hay.select("hay").limit(0))
    for least, most in ((1, SHORT), (SHORT + 1, GRAM)):
        some = materialize_table(needles.where(n.between(least, most)).withColumnRenamed("needle_text", "run"), "needles")
        sizes = sorted(r["size"] for r in some.select(F.length("run").alias("size")).distinct().collect())
        if sizes:
            runs = hay.select("hay", F.explode(_runs(F.col("text"), sizes)).alias("run"))
            found = found.unionAll(runs.join(some if most == SHORT else some.hint("shuffle_hash"), "run").select("needle", "hay"))
    long = materialize_table(needles.where(n > GRAM).select("needle", "needle_text", F.explode(_runs(F.col("needle_text"), [GRAM])).alias("run")), "needle-runs")
    if not long.isEmpty():
        index = materialize_table(hay.where(F.length("text") > GRAM).select("hay", "text", F.explode(_runs(F.col("text"), [GRAM])).alias("run")), "run-index")
        counts = index.groupBy("run").agg(F.count("*").alias("c"))
        # a run that the index lacks counts 0: the needle is nowhere
        rarest = long.join(counts, "run", "left").groupBy("needle", "needle_text").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "run")).alias("r"))
        asked = rarest.where("r.c > 0").select("needle", "needle_text", F.col("r.run").alias("run"))
        found = found.unionAll(asked.join(index, "run").where(F.contains("text", "needle_text")).select("needle", "hay"))
    return found


def search_dictionary(queries: DataFrame, dictionary: DataFrame, variations: DataFrame, best: int = 20) -> DataFrame:
    """(query, place, code, term, match_type, score) with the `best` entries
    of each query: a known variation of the term or the term itself (1), a term
    that holds the query or is held by it (share of the lengths), a code that
    holds it (0.9).  An entry counts once, by the first of these that it meets;
    ties go to the earlier kind, then to the code.

    queries: (query); dictionary: (code, term); variations: (variation, term)."""
    asked = queries.select("query", F.lower(F.trim("query")).alias("text")).where(F.col("text") != "").distinct()
    asked = materialize_table(asked.withColumn("id", F.col("query")), "dictionary-queries")
    entries = materialize_table(dictionary.select(F.struct("code", "term").alias("id"), F.lower("term").alias("text")).distinct(), "dictionary-entries")
    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "kind", "code", "term")
    known = variations.select(F.lower("variation").alias("text"), F.col("term").alias("standard")).distinct()
    varied = asked.join(known, "text").join(entries.select(F.col("id").alias("entry")), F.col("standard") == F.col("entry.term")).select("query", "entry.code", "entry.term", F.lit(0).alias("kind"), F.lit(1.0).alias("score"))
    holds = _holding(asked.select("id", "text"), entries).select(F.col("needle").alias("query"), F.col("hay").alias("entry"), F.lit(True).alias("holds"))
    held = _holding(entries, asked.select("id", "text")).select(F.col("hay").alias("query"), F.col("needle").alias("entry"), F.lit(False).alias("holds"))
    q, term = F.lower(F.trim("query")), F.lower("entry.term")
    kind = F.when(q == term, 1).when(F.col("holds"), 2).otherwise(3)
    share = F.least(F.length(q) / F.length(term), F.length(term) / F.length(q))  # the shorter one's
    pairs = holds.unionAll(held.where(q != term)).select("query", "entry.code", "entry.term", kind.alias("kind"), share.alias("score"))
    # an entry ahead of these is ahead of them among all, so their best hold all that count
    pairs = pairs.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= best).drop("place")
    codes = _holding(asked.select("id", "text"), entries.select("id", F.lower("id.code").alias("text"))).select(F.col("needle").alias("query"), F.col("hay").alias("entry"))
    met = (term != "") & (F.contains(term, q) | F.contains(q, term))  # by the term itself
    codes = codes.where(~F.coalesce(met, F.lit(False))).select("query", "entry.code", "entry.term", F.lit(4).alias("kind"), F.lit(0.9).alias("score"))
    every = varied.unionAll(pairs).unionAll(codes)
    once = every.groupBy("query", "code", "term").agg(F.min(F.struct("kind", "score")).alias("m")).select("query", "code", "term", "m.kind", "m.score")
    place = F.row_number().over(best_first)
    names = F.array(*map(F.lit, ("exact_variation", "exact", "contains", "partial", "code")))
    return once.withColumn("place", place).where(F.col("place") <= best).select("query", "place", "code", "term", names[F.col("kind")].alias("match_type"), "score")
