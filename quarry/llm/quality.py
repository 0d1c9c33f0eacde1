"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words.  Every passage of
the whole text is encoded (shares of character classes, word shape,
repetition, hashed words), projected, and weighted by gated attention; the
weighted sum of the bag is scored by a logistic output.  Only documents carry
labels, so encoder, attention and output are learnt together from them.

The model is fitted with numpy at the driver on a bounded sample: at most
`TRAIN_ROWS` labelled documents (those with the least hash of doc_id among the
rows that may be learnt from), each with its whole text.  Scoring has no such
bound.  Nothing but the text enters a score.

Defined results: a null, empty or white text is a bag of one blank passage and
gets a score; without labels of both classes every score is their mean (0.5
without any); several labels of a document count by their mean, null labels
not at all; a null doc_id is not held out; repeated rows repeat; an empty
table gives an empty one.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, map_arrow, text_blocks, texts_of

PASSAGE_WORDS = 64
TRAIN_ROWS = 4000
THRESHOLD = 0.3
FOLDS = 5

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "|", "*", "#$%&", "\"'`", "()[]{}<>",
            "=+_/\\^~@", ":;-")
N_CLASSES = len(_CLASSES) + 2
HASHED = 32
N_SHAPE = 8
N_FEATURES = N_CLASSES + N_SHAPE + HASHED + 1

_CLASS = np.full(256, N_CLASSES - 1, np.int64)
_CLASS[128:] = len(_CLASSES)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _k
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\r\x0b\x0c")] = True
_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX[_WHITE] = 0
_PLACE = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's passages begin."""
    blobs = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*blobs, b""]), np.uint8)
    doc_at = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])]).astype(np.int64)[:-1]
    white = _WHITE[data]
    before = np.empty_like(white)
    before[:1], before[1:] = True, white[:-1]
    word_at = np.flatnonzero(~white & before)
    word_doc = np.searchsorted(doc_at, word_at, "right") - 1
    n_words = np.bincount(word_doc, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    in_doc = np.arange(len(word_at)) - first_word[word_doc]
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    bag_at = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(word_at):
        out[:, -1] = 1
        return out, bag_at
    word_pass = bag_at[word_doc] + in_doc // PASSAGE_WORDS
    # bytes from a passage's first word to the next passage or the text's end
    byte_pass = np.full(len(data), total, np.int64)
    starts = np.flatnonzero(in_doc % PASSAGE_WORDS == 0)
    edges = np.concatenate([doc_at, word_at[starts]])
    owner = np.concatenate([np.full(len(doc_at), total), word_pass[starts]])
    order = np.argsort(edges, kind="stable")
    edges, owner = edges[order], owner[order]
    byte_pass = np.repeat(owner, np.diff(np.append(edges, len(data))))
    counts = np.bincount(byte_pass * N_CLASSES + _CLASS[data], minlength=(total + 1) * N_CLASSES).reshape(-1, N_CLASSES)[:total]
    n_bytes = np.maximum(1, counts.sum(axis=1, keepdims=True))
    out[:, :N_CLASSES] = counts / n_bytes
    # words: shape, repetition, hashes
    place = np.arange(len(data)) - np.repeat(np.append([0], word_at), np.diff(np.append(np.append([0], word_at), len(data))))
    hashes = np.add.reduceat(_MIX[data] * _PLACE[place & 63], word_at)
    white_at = np.append(np.flatnonzero(white & ~before), len(data))
    length = white_at[np.searchsorted(white_at, word_at)] - word_at
    last = data[word_at + length - 1]
    n = np.maximum(1, np.bincount(word_pass, minlength=total)).astype(np.float32)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(word_pass, weights=flag, minlength=total) / n

    again = np.zeros(len(word_at), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_pass[1:] == word_pass[:-1])
    by = np.lexsort((hashes, word_pass))
    new = np.ones(len(by), bool)
    new[1:] = (hashes[by][1:] != hashes[by][:-1]) | (word_pass[by][1:] != word_pass[by][:-1])
    upper = (data[word_at] >= 65) & (data[word_at] <= 90)
    alnum_end = (_CLASS[last] < 3) | (last >= 128)
    shape = (share(length) / 8, share(length.astype(float) ** 2) / 64, share(again), np.bincount(word_pass[by], weights=new, minlength=total) / n,
             share(upper), share(~alnum_end), share(length == 1), n / PASSAGE_WORDS)
    out[:, N_CLASSES:N_CLASSES + N_SHAPE] = np.stack(shape, axis=1)
    bucket = ((hashes >> np.uint64(20)) % np.uint64(HASHED)).astype(np.int64)
    bag = np.bincount(word_pass * HASHED + bucket, minlength=total * HASHED).reshape(-1, HASHED)
    out[:, -HASHED - 1:-1] = bag / n[:, None]
    out[bag_at[n_words == 0]] = 0
    out[bag_at[n_words == 0], -1] = 1
    return out, bag_at


def _sums(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, at, axis=0)


@dataclass
class Model:
    """Weights of encoder (W, b), gate (V, U, a) and output (c, bias), after
    standardising by mean and scale."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.w:
            return np.full(len(at), float(self.mean[0]))
        return forward(self.w, standardised(rows, self.mean, self.scale), at)["p"]


def standardised(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What the encoder sees, in training and in scoring alike."""
    return np.clip((rows - mean) / scale, -8, 8)


def forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """One pass over bags that begin at `at`; keeps what the gradient needs."""
    size = np.diff(np.append(at, len(x)))
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (v * u) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), size))
    alpha = e / np.repeat(_sums(e, at), size)
    z = _sums(alpha[:, None] * h, at)
    p = 1 / (1 + np.exp(-(z @ w["c"] + w["bias"])))
    return {"size": size, "h": h, "v": v, "u": u, "alpha": alpha, "z": z, "p": p}


def gradient(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss with weight decay."""
    f = forward(w, x, at)
    d = (f["p"] - y) / len(y)
    rep = np.repeat(d, f["size"])
    g = {"c": f["z"].T @ d, "bias": np.array(d.sum())}
    dh = (rep * f["alpha"])[:, None] * w["c"]
    s = rep * (f["h"] @ w["c"])  # by alpha
    s = f["alpha"] * (s - np.repeat(_sums(f["alpha"] * s, at), f["size"]))  # by the attention logit
    g["a"] = (f["v"] * f["u"]).T @ s
    dv = s[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
    du = s[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
    g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
    dh = (dh + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
    g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
    return {k: g[k] + decay * w[k] for k in w}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, seed: int = 3) -> Model:
    """Adam over small batches of bags."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.array([labels.mean() if len(labels) else 0.5]), np.ones(1), {})
    rows = np.concatenate(bags)
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    bags = [standardised(b, mean, scale) for b in bags]
    rng = np.random.default_rng(seed)
    shapes = {"W": (rows.shape[1], hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) * (k != "b") for k, s in shapes.items()}
    w["bias"] = np.array(np.log(labels.mean() / (1 - labels.mean())))
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(bags)), 5e-3 * 0.5 ** (epoch / 12)
        for k in range(0, len(order), batch):
            some = order[k:k + batch]
            x = np.concatenate([bags[i] for i in some])
            at = np.cumsum([0, *[len(bags[i]) for i in some]])[:-1]
            step += 1
            for name, g in gradient(w, x, at, labels[some], 1e-4).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                s[name] = 0.999 * s[name] + 0.001 * g * g
                w[name] = w[name] - rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(s[name] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold."""
    sample = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
              .where("quality IS NOT NULL AND doc_id IS NOT NULL"))
    # of documents that exist, those with the least hash: a bounded list
    there = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    chosen = sample.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def features(batch: pa.RecordBatch):
        for block in text_blocks(batch):
            x, at = encode(texts_of(block))
            bags = np.split(x, at[1:])
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), column(block, "quality"), pa.array([b.astype(np.float16).tobytes() for b in bags], pa.binary())],
                                             names=["doc_id", "quality", "bag"])

    copies = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # one text of each chosen document, however often its id is repeated
    least = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("text")
    texts = copies.groupBy("doc_id").agg(least, F.first("quality").alias("quality"))
    got = map_arrow(texts, features, "doc_id bigint, quality double, bag binary").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, N_FEATURES).astype(np.float64) for r in got]
    return fit(bags, np.array([r["quality"] >= 0.5 for r in got], float))


def _scored(model: Model, texts: list[str]) -> np.ndarray:
    x, at = encode(texts)
    return model.scores(x.astype(np.float64), at)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batch: pa.RecordBatch):
        for block in text_blocks(batch):
            score = _scored(sent.value, texts_of(block))
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), column(block, "held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batch: pa.RecordBatch):
        for block in text_blocks(batch):
            yield block.filter(pa.array(_scored(sent.value, texts_of(block)) >= THRESHOLD))

    return map_arrow(docs, run, docs.schema)
