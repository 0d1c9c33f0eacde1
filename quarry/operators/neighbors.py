"""Exact nearest neighbours, local outlier factors and synthetic minority rows.

Equal vectors are one point with its least row ids (k + 1 are enough).  About
sqrt(n) pivots, the points of least hash, cut the space into cells, so dense
places get more of them.  Each point first looks in its own cell; its distance
to the neighbour found last bounds what is still of interest, and by the
triangle inequality only cells with
    d(point, pivot) - radius(cell) <= bound
can hold a nearer one.  The point is sent to those cells alone, and the best of
all finds stay: k + 1 rows for each point, never pairs of rows.  A cell that
many points visit serves them in parts.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ml import ordered_row_number
from quarry.session import materialize_table

#: Visiting points that one task serves for one cell.
VISITS = 20_000
ROWS = 512  # points compared at once

NEAR = "array<struct<d:double,id:string>>"


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - y[None, :, j]) ** 2
    return np.sqrt(total)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _nearest(x: np.ndarray, y: np.ndarray, ids: list[list[str]], k: int, bound: np.ndarray | None = None) -> list[list[dict]]:
    """For each x the k rows of least (distance, id) among the points y, each
    with its row ids; within `bound` where one is given."""
    out = []
    for a in range(0, len(x), ROWS):
        d = distances(x[a:a + ROWS], y)
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
        if bound is not None:
            last = np.minimum(last, bound[a:a + ROWS])
        for row, limit in zip(d, last):
            some = np.flatnonzero(row <= limit)
            found = sorted((float(row[j]), i) for j in some for i in ids[j])
            out.append([{"d": v, "id": i} for v, i in found[:k]])
    return out


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their `k` least row ids."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_n") <= k)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("pid", F.col("ids")[0])


def nearest_points(rows: DataFrame, k: int) -> DataFrame:
    """(vec, near) for the distinct vectors of rows (id string, vec
    array<double>): the k rows of least (distance, id), the own ones included."""
    points = materialize_table(_points(rows, k), "knn-points")
    n = points.count()
    if not n:
        return rows.sparkSession.createDataFrame([], f"vec array<double>, near {NEAR}")
    # sqrt(n) vectors: what is sent to every task grows with the root of the input
    pivots = np.array([r["vec"] for r in points.orderBy(F.xxhash64("vec"), "vec").limit(int(np.ceil(np.sqrt(n)))).select("vec").collect()], float).reshape(-1, len(points.first()["vec"]))
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = np.array(part.column(part.schema.get_field_index("vec")).to_pylist(), float).reshape(part.num_rows, -1)
                d = distances(x, sent.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*part.schema.names, "cell", "dist"])

    cells = materialize_table(points.mapInArrow(assign, "vec array<double>, ids array<string>, pid string, cell int, dist double"), "knn-cells")
    radius = np.full(len(pivots), -np.inf)
    for r in cells.groupBy("cell").agg(F.max("dist").alias("r")).collect():
        radius[r["cell"]] = r["r"]
    reach = rows.sparkSession.sparkContext.broadcast(radius)

    def own(part: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(part["vec"])
        near = _nearest(x, x, part["ids"].tolist(), k)
        bound = np.array([f[k - 1]["d"] if len(f) == k else np.inf for f in near])
        cell, visits = int(part["cell"].iloc[0]), []
        for a in range(0, len(x), ROWS):
            least = distances(x[a:a + ROWS], sent.value) - reach.value
            open_ = least <= bound[a:a + ROWS, None] * (1 + 1e-9) + 1e-9
            open_[:, cell] = False
            visits += [np.flatnonzero(o).tolist() for o in open_]
        return pd.DataFrame({"pid": part["pid"], "vec": part["vec"], "near": near, "bound": bound, "visits": visits})

    found = materialize_table(cells.groupBy("cell").applyInPandas(own, f"pid string, vec array<double>, near {NEAR}, bound double, visits array<int>"), "knn-own")
    guests = found.select("pid", "vec", "bound", F.explode("visits").alias("cell"))
    parts = guests.groupBy("cell").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
    guests = guests.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
    hosts = cells.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def visit(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        if not len(guest) or not len(host):
            return pd.DataFrame({"pid": [], "near": []})
        near = _nearest(_vectors(guest["vec"]), _vectors(host["vec"]), host["ids"].tolist(), k, guest["bound"].to_numpy(float))
        return pd.DataFrame({"pid": guest["pid"], "near": near})

    abroad = (guests.select("cell", "part", "pid", "vec", "bound").groupBy("cell", "part")
              .cogroup(hosts.select("cell", "part", "vec", "ids").groupBy("cell", "part")).applyInPandas(visit, f"pid string, near {NEAR}"))
    finds = found.select("pid", F.explode("near").alias("f")).unionByName(abroad.select("pid", F.explode("near").alias("f")))
    best = finds.withColumn("_n", F.row_number().over(Window.partitionBy("pid").orderBy("f.d", "f.id"))).where(F.col("_n") <= k)
    near = best.groupBy("pid").agg(F.sort_array(F.collect_list("f")).alias("near"))
    return found.select("pid", "vec").join(near, "pid").select("vec", "near")


def nearest_rows(df: DataFrame, id_col: str, features: list[str], k: int) -> DataFrame:
    """(id, near) for every row: its k nearest other rows as (d, id), by
    distance and then id.  Rows with a null id or feature have none; ids are
    distinct and compared as text."""
    vec = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.col(id_col).cast("string").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))
    points = nearest_points(rows, k + 1)
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return rows.join(points, "vec").select("id", others.alias("near"))


def outlier_factors(df: DataFrame, id_col: str, features: list[str], k: int = 20) -> DataFrame:
    """(id, lof), the local outlier factor: the mean local reachability
    density of the k nearest rows over the row's own."""
    near = materialize_table(nearest_rows(df, id_col, features, k), "lof-near")
    links = near.select("id", F.posexplode("near").alias("place", "n")).select("id", F.col("n.id").alias("other"), F.col("n.d").alias("d"))
    reach = near.where(F.size("near") > 0).select(F.col("id").alias("other"), F.element_at("near", -1)["d"].alias("kdist"))
    density = materialize_table(links.join(reach, "other").groupBy("id").agg((1 / (F.avg(F.greatest("kdist", "d")) + 1e-10)).alias("lrd")), "lof-density")
    around = links.join(density.select(F.col("id").alias("other"), F.col("lrd").alias("theirs")), "other").groupBy("id").agg(F.avg("theirs").alias("theirs"))
    return around.join(density, "id").select("id", (F.col("theirs") / F.col("lrd")).alias("lof"))


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that hangs on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def smote(df: DataFrame, id_col: str, label: str, features: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, label, features, synthetic, base, other, gap): all rows, and
    for every smaller class as many synthetic ones as the largest class has
    more.  A synthetic row lies `gap` of the way from a base row to one of its
    k nearest rows of the class; a class of one row repeats it.  Classes are
    few; each is searched by itself."""
    keep = [F.col(c).cast("double").alias(c) for c in features]
    rows = materialize_table(df.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("string").alias("label"), *keep), "smote-rows")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    none = lambda t: F.lit(None).cast(t)
    out = rows.select("*", F.lit(False).alias("synthetic"), none("string").alias("base"), none("string").alias("other"), none("double").alias("gap"))
    for name, n in sorted(sizes.items(), key=lambda s: str(s[0])):
        need = max(sizes.values()) - n
        if not need:
            continue
        own = rows.where(F.col("label").eqNullSafe(name))
        numbered = ordered_row_number(own, [], ["id"], "nth")
        links = nearest_rows(own, "id", features, k).withColumnRenamed("id", "base")
        made = rows.sparkSession.range(need).select("id", (F.floor(_unit(F.lit(seed), F.lit(name), "id", F.lit("base")) * n) + 1).alias("nth"),
                                                     _unit(F.lit(seed), F.lit(name), "id", F.lit("other")).alias("pick"), _unit(F.lit(seed), F.lit(name), "id", F.lit("gap")).alias("gap"))
        made = made.withColumnRenamed("id", "number").join(numbered.withColumnRenamed("id", "base"), "nth").join(links, "base", "left")
        made = made.withColumn("other", F.get("near", F.floor(F.col("pick") * F.size("near")).cast("int"))["id"])
        ends = own.select(F.col("id").alias("other"), *[F.col(c).alias(f"_o_{c}") for c in features])
        made = made.join(ends, "other", "left")
        between = [(F.col(c) + F.col("gap") * (F.coalesce(f"_o_{c}", c) - F.col(c))).alias(c) for c in features]
        out = out.unionByName(made.select(F.concat(F.lit("synthetic-"), F.coalesce(F.lit(name), F.lit("")), F.lit("-"), F.col("number").cast("string")).alias("id"), F.lit(name).cast("string").alias("label"),
                                          *between, F.lit(True).alias("synthetic"), "base", "other", "gap"))
    return out
