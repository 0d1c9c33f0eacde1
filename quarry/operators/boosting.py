"""Gradient boosting on histograms, for many outputs in the same passes
(M8 classes, M9 labels, M10 quantiles).

Features are cut into at most `BINS` bins at exact quantiles.  A round grows one
tree for every output, all outputs together, a level at a time: each task sums
the gradients of its rows by (output, node, feature, bin), one grouping adds
the tasks up, and the best splits are read from sums whose number does not
follow the rows.  Rows that have no target for an output (held out, or of no
concern to a specialist) do not count for it, but are predicted.  Predictions
of finished trees are written with the rows every few rounds, so a pass walks
few trees and a lost executor costs little.  What a pass reads of a row is two
or three short binary values (`_pack`), and it works on whole columns.

Losses: `softmax` over outputs of one group, `logistic`, and `quantile`, whose
leaves take the quantile of what is left in them (from a fine histogram).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.quantiles import exact_quantiles
from quarry.session import materialize_table

BINS = 32
ROUNDS, DEPTH, RATE, DECAY, LEAST_ROWS = 20, 3, 0.3, 1.0, 10
WRITTEN_EVERY = 7
RESIDUAL_BINS = 512
PACKED = "bins binary, y binary, p binary"


@dataclass(frozen=True)
class Output:
    """A target column (null: the row does not count) and its loss; `group`
    names the outputs of one softmax, `tau` is a quantile's."""

    name: str
    target: Column | None
    loss: str
    tau: float = 0.5
    group: str = ""


@dataclass
class Tree:
    """Split feature (-1 at a leaf), last bin of the left side and leaf value,
    by node; node 1 is the root, node i has the children 2 i and 2 i + 1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 1 << (depth + 1)
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = {1: np.ones(len(bins), bool)}  # whether a row comes by a node
        for i in np.flatnonzero(self.feature >= 0).tolist():  # parents stand before their children
            here, right = at.pop(i), bins[:, self.feature[i]] > int(self.cut[i])
            at[2 * i], at[2 * i + 1] = here & ~right, here & right
        kind = np.min_scalar_type(len(self.feature) - 1)
        node = np.zeros(len(bins), kind)
        for i, own in at.items():
            node += own.astype(kind) * kind.type(i)
        return node


def gradients(outputs: Sequence[Output], y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of each output's loss, 0 without a target."""
    g, h = np.zeros(p.shape, order="F"), np.zeros(p.shape, order="F")
    for k, o in enumerate(outputs):
        if o.loss == "quantile":
            g[:, k], h[:, k] = np.take(np.array([1 - o.tau, -o.tau]), (y[:, k] >= p[:, k]).astype(np.intp)), 1.0
        elif o.loss == "logistic":
            share = 1 / (1 + np.exp(-p[:, k]))
            g[:, k], h[:, k] = share - y[:, k], np.maximum(share * (1 - share), 1e-6)
        else:
            own = [j for j, x in enumerate(outputs) if x.group == o.group and x.loss == o.loss]
            e = np.exp(p[:, own] - p[:, own].max(axis=1, keepdims=True))
            share = e[:, own.index(k)] / e.sum(axis=1)
            g[:, k], h[:, k] = share - y[:, k], np.maximum(share * (1 - share), 1e-6)
    for k in range(len(outputs)):  # column by column, as they are stored
        missing = np.isnan(y[:, k])
        if missing.any():
            g[missing, k] = h[missing, k] = 0.0
    return g, h


def best_split(sums: np.ndarray, least_rows: int = LEAST_ROWS, decay: float = DECAY) -> tuple[int, int, float]:
    """(feature, last bin of the left side, gain) of a node's sums (features x
    bins x gradient, curvature, rows); feature -1 where nothing is gained."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + decay)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[..., 2] < least_rows) | (right[..., 2] < least_rows)] = -np.inf
    f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(f), int(cut), float(gain[f, cut])) if gain[f, cut] > 1e-9 else (-1, 0, 0.0)


@dataclass
class Boosted:
    """The rows with their bins, and the predictions of all outputs so far."""

    outputs: list[Output]
    packed: DataFrame  # id; bins, y and p, each as one binary value; p is that of all rounds but the fresh
    edges: list[np.ndarray]
    spans: dict[int, tuple[float, float]]  # of a quantile's residuals
    trees: list[list[Tree]] = field(default_factory=list)  # by round
    fresh: list[list[Tree]] = field(default_factory=list)  # not yet in p

    @property
    def rows(self) -> DataFrame:
        """(id, bins, y, p), each an array."""
        read = _read(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bins, y, p in read(iter([batch])):
                    yield pa.RecordBatch.from_arrays([batch.column(0), _lists(bins.astype(np.int32)), _lists(y), _lists(p)], names=["id", "bins", "y", "p"])

        return self.packed.select("id", "bins", "y", "p").mapInArrow(run, "id string, bins array<int>, y array<double>, p array<double>")

    @property
    def kind(self) -> np.dtype:
        """The least type that holds a bin."""
        return np.min_scalar_type(max(len(e) for e in self.edges) + 1)


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(matrix).ravel()))


def _packed(matrix: np.ndarray) -> pa.Array:
    """A row of numbers as one binary value."""
    data = np.ascontiguousarray(matrix)
    fixed = pa.Array.from_buffers(pa.binary(data.itemsize * data.shape[1]), len(data), [None, pa.py_buffer(data)])
    return fixed.cast(pa.binary())


def _unpacked(batch: pa.RecordBatch, name: str, kind: np.dtype, width: int) -> np.ndarray:
    """The matrix of a packed column, its columns contiguous."""
    kind = np.dtype(kind)
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary(kind.itemsize * width))
    flat = np.frombuffer(column.buffers()[1], kind, batch.num_rows * width, column.offset * kind.itemsize * width)
    return np.asfortranarray(flat.reshape(batch.num_rows, width))


def _predict(p: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    p = p.copy(order="F")
    for trees in rounds:
        for k, tree in enumerate(trees):
            p[:, k] += np.take(tree.value, tree.nodes(bins))
    return p


def _read(model: Boosted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """What turns batches of packed rows into bins, targets and predictions."""
    kind, fresh, n_features, n_outputs = model.kind, model.fresh, len(model.edges), len(model.outputs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                bins = _unpacked(batch, "bins", kind, n_features)
                yield bins, _unpacked(batch, "y", float, n_outputs), _predict(_unpacked(batch, "p", float, n_outputs), bins, fresh)

    return read


def prepare(df: DataFrame, key: str, features: Sequence[str], outputs: list[Output], bins: int = BINS) -> Boosted:
    """Cut features into bins (null is a bin of its own, the first) and start
    each output at its mean, log-odds or quantile."""
    cuts = exact_quantiles(df, list(features), [i / bins for i in range(1, bins)])
    edges = [np.unique([v for v in cuts[c] if v is not None]) for c in features]

    wide = df.select(*[o.target.cast("double").alias(f"y{k}") for k, o in enumerate(outputs)])
    ends = [f(c).alias(f"{n}_{c}") for c in wide.columns for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))]
    one = wide.agg(*ends).first()
    quantile: dict[float, list[int]] = {}
    for k, o in enumerate(outputs):
        if o.loss == "quantile":
            quantile.setdefault(o.tau, []).append(k)
    at = {f"y{k}": v for tau, ks in quantile.items() for c, (v,) in exact_quantiles(wide, [f"y{k}" for k in ks], [tau]).items() for k in [int(c[1:])]}
    start = []
    for k, o in enumerate(outputs):
        if o.loss == "quantile":
            start.append(at[f"y{k}"] or 0.0)
        else:
            share = min(max(one[f"mean_y{k}"] or 0.0, 1e-6), 1 - 1e-6)
            start.append(float(np.log(share) if o.loss == "softmax" else np.log(share / (1 - share))))
    width = {k: (one[f"high_y{k}"] or 0.0) - (one[f"low_y{k}"] or 0.0) for k, o in enumerate(outputs) if o.loss == "quantile"}
    model = Boosted([replace(o, target=None) for o in outputs], df, edges, {k: (-w, w) for k, w in width.items()})  # tasks get no Columns
    kind, n_features, n_outputs = model.kind, len(edges), len(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                column = lambda i: batch.column(i).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731  a null is NaN
                at = np.zeros((n, n_features), kind, "F")
                for f, e in enumerate(edges):
                    v = column(1 + f)
                    at[:, f] = np.where(np.isnan(v), 0, np.searchsorted(e, v) + 1)
                y = np.stack([column(1 + n_features + k) for k in range(n_outputs)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _packed(at), _packed(y), _packed(np.tile(np.array(start, float), (n, 1)))], names=["id", "bins", "y", "p"])

    flat = df.select(F.col(key).cast("string").alias("id"), *[F.col(c).cast("double").alias(f"f{f}") for f, c in enumerate(features)], *[o.target.cast("double").alias(f"y{k}") for k, o in enumerate(outputs)])
    model.packed = materialize_table(flat.mapInArrow(run, f"id string, {PACKED}"), "boost-rows")
    return model


def _sums(model: Boosted, growing: list[Tree], level: int, n_bins: int) -> np.ndarray:
    """(output, node of the level, feature, bin, gradient / curvature / rows)."""
    outputs, read, n_features, first, wide = model.outputs, _read(model), len(model.edges), 1 << level, 1 << level
    shape = (len(outputs), wide, n_features, n_bins, 3)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(shape), wide * n_bins
        for bins, y, p in read(batches):
            g, h = gradients(outputs, y, p)
            columns = bins.T.astype(np.intp)
            for k, tree in enumerate(growing):
                node = tree.nodes(bins).astype(np.intp) - first
                own = ~np.isnan(y[:, k]) & (node >= 0) & (node < wide)
                if not own.all():
                    rows = np.flatnonzero(own)
                    node, of, weights = node[rows], columns[:, rows], (g[rows, k], h[rows, k])
                else:
                    of, weights = columns, (g[:, k], h[:, k])
                node *= n_bins
                for f in range(n_features):
                    at = node + of[f]
                    n = np.bincount(at, minlength=size)
                    # a quantile's curvature is 1 a row
                    for j, w in enumerate((np.bincount(at, weights[0], size), n if outputs[k].loss == "quantile" else np.bincount(at, weights[1], size), n)):
                        total[k, :, f, :, j] += w.reshape(wide, n_bins)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["at", "v"])

    out = np.zeros(int(np.prod(shape)))
    # outputs * nodes * features * bins * 3 at most
    got = model.packed.select("bins", "y", "p").mapInArrow(part, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(shape)


def _leaf_quantiles(model: Boosted, growing: list[Tree], spans: dict[int, tuple[float, float]]) -> dict[tuple[int, int], float]:
    """The tau-quantile of the residuals in each leaf of the quantile outputs."""
    outputs, read, wide = model.outputs, _read(model), len(growing[0].feature)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(wide * RESIDUAL_BINS) for k in spans}
        for bins, y, p in read(batches):
            for k, (lo, hi) in spans.items():
                rows = np.flatnonzero(~np.isnan(y[:, k]))
                at = np.clip(((y[rows, k] - p[rows, k] - lo) / max(hi - lo, 1e-12) * RESIDUAL_BINS).astype(int), 0, RESIDUAL_BINS - 1)
                total[k] += np.bincount(growing[k].nodes(bins)[rows].astype(np.intp) * RESIDUAL_BINS + at, minlength=wide * RESIDUAL_BINS)
        for k, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at // RESIDUAL_BINS, pa.int32()), pa.array(at % RESIDUAL_BINS, pa.int32()), pa.array(t[at])], names=["k", "node", "bin", "c"])

    got: dict[tuple[int, int], np.ndarray] = {}
    # quantile outputs * leaves * RESIDUAL_BINS at most
    sums = model.packed.select("bins", "y", "p").mapInArrow(part, "k int, node int, bin int, c double").groupBy("k", "node", "bin").agg(F.sum("c").alias("c")).toArrow()
    for k, node, b, c in zip(*(sums[x].to_pylist() for x in ("k", "node", "bin", "c"))):
        got.setdefault((k, node), np.zeros(RESIDUAL_BINS))[b] = c
    out = {}
    for (k, node), counts in got.items():
        lo, hi = spans[k]
        cum = np.cumsum(counts)
        want = outputs[k].tau * cum[-1]
        b = int(np.searchsorted(cum, want))
        inside = (want - (cum[b - 1] if b else 0.0)) / max(counts[b], 1.0)
        out[k, node] = lo + (b + inside) * (hi - lo) / RESIDUAL_BINS
    return out


def boost(df: DataFrame, key: str, features: Sequence[str], outputs: list[Output], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
          bins: int = BINS, least_rows: int = LEAST_ROWS) -> Boosted:
    """Fit all outputs together on the rows that have their targets."""
    model = prepare(df, key, features, outputs, bins)
    for _ in range(rounds):
        growing = [Tree.empty(depth) for _ in outputs]
        for level in range(depth):
            sums = _sums(model, growing, level, bins + 1)
            for k, tree in enumerate(growing):
                for i in range(1 << level):
                    node = (1 << level) + i
                    if level and tree.feature[node // 2] < 0:
                        continue
                    s = sums[k, i]
                    f, cut, _ = best_split(s, least_rows)
                    total = s[0].sum(axis=0)
                    tree.value[node] = -rate * total[0] / (total[1] + DECAY)
                    if f >= 0:
                        tree.feature[node], tree.cut[node] = f, cut
                        for child, side in ((2 * node, s[f, :cut + 1]), (2 * node + 1, s[f, cut + 1:])):
                            t = side.sum(axis=0)
                            tree.value[child] = -rate * t[0] / (t[1] + DECAY)
        for (k, node), q in (_leaf_quantiles(model, growing, model.spans) if model.spans else {}).items():
            growing[k].value[node] = rate * q
        model.trees.append(growing)
        model.fresh.append(growing)
        if len(model.fresh) == WRITTEN_EVERY:
            model.packed, model.fresh = materialize_table(predicted(model, keep=True), "boost-predictions"), []
    return model


def predicted(model: Boosted, keep: bool = False) -> DataFrame:
    """(id, p) of all rows, p by output: the log-odds or the quantile; with
    `keep` the packed rows with these."""
    read = _read(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, p in read(iter([batch])):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _packed(p)] if keep else [batch.column(0), _lists(p)], names=names)

    names = model.packed.columns if keep else ["id", "p"]
    return model.packed.mapInArrow(run, f"id string, {PACKED}" if keep else "id string, p array<double>")


def shares(p: Column, among: Sequence[int]) -> Column:
    """Softmax probabilities of the outputs at these places."""
    top = F.greatest(*[p[k] for k in among]) if len(among) > 1 else p[among[0]]
    e = [F.exp(p[k] - top) for k in among]
    return F.array(*[x / sum(e[1:], e[0]) for x in e])


def chance(p: Column) -> Column:
    return 1 / (1 + F.exp(-p))
