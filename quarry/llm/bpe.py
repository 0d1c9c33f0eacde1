"""Byte-level BPE encoding and decoding by merge replay over a corpus.

The distinct pre-tokens of a block of documents are one corpus of words.  An
inverted index leads from the rank of a mergeable pair to the positions where
it stands; the ranks are replayed in order, each merge touches only the
positions listed for it, and only the two neighbours of a merged position are
indexed again.  Blocks are bounded (`common.BLOCK_CHARS`), so a task's memory
does not follow the corpus, and words already replayed are remembered.

Where a merge brings up a pair of a lower rank inside a word (the same bytes
were learnt from another split), the word's later positions of the current
rank wait until that lower rank is done, so every word gets exactly the
merges that a word-by-word encoder gives it.

Defined results: a null or empty text has no ids, hashes of no bytes, and
decodes to no bytes; repeated rows repeat; an empty table gives an empty one;
other columns are left behind.
"""
from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.chunks import PieceMemo
from quarry.llm.common import column, map_arrow, text_blocks, texts_of

ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many words at once by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: data for data, rank in ranks.items()}
        self._byte = [ranks[bytes([b])] for b in range(256)]
        self._pairs: dict[tuple[int, int], int] = {}

    def _rank(self, a: int, b: int) -> int:
        """Rank of the pair's merge, or -1."""
        rank = self._pairs.get((a, b))
        if rank is None:
            rank = self._pairs[a, b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return rank

    def encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        ids: list[int] = []
        left: list[int] = []
        right: list[int] = []
        word: list[int] = []
        first: list[tuple[int, int]] = []
        for w, data in enumerate(words):
            whole = self.ranks.get(data)
            if whole is not None:  # a word that is a token stays one
                out[w] = [whole]
                continue
            at, n = len(ids), len(data)
            first.append((w, at))
            ids.extend(self._byte[b] for b in data)
            left.extend((-1, *range(at, at + n - 1)) if n else ())
            right.extend((*range(at + 1, at + n), -1) if n else ())
            word.extend([w] * n)
        spots: dict[int, list[int]] = {}
        rank_of = self._rank
        for i, j in enumerate(right):
            if j >= 0 and (rank := rank_of(ids[i], ids[j])) >= 0:
                spots.setdefault(rank, []).append(i)
        order = list(spots)
        heapify(order)
        while order:
            rank = heappop(order)
            waiting: set[int] = set()
            later: list[int] = []
            for i in sorted(spots.pop(rank)):
                if word[i] in waiting:
                    later.append(i)
                    continue
                j = right[i]
                if ids[i] < 0 or j < 0 or rank_of(ids[i], ids[j]) != rank:
                    continue  # a neighbour's merge took this position
                after, before = right[j], left[i]
                ids[i], ids[j], right[i] = rank, -1, after
                if after >= 0:
                    left[after] = i
                for a, b in ((before, i), (i, after)):
                    if a >= 0 and b >= 0 and (new := rank_of(ids[a], ids[b])) >= 0:
                        if new not in spots and new != rank:
                            spots[new] = []
                            heappush(order, new)
                        (later if new == rank else spots[new]).append(a)
                        if new < rank:
                            waiting.add(word[i])
            if later:
                spots.setdefault(rank, []).extend(later)
                heappush(order, rank)
        for w, i in first:
            got = out[w] = []
            if words[w]:
                while i >= 0:
                    got.append(ids[i])
                    i = right[i]
        return out


class Codec:
    """Whole texts to ids and back; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        self._replay, self._pattern = MergeReplay(read_ranks(path)), regex.compile(pattern)
        self._token = self._replay.token
        self._memo = PieceMemo(self._pieces)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self._pattern.findall(p) for p in pieces]
        number: dict[str, int] = {}
        for words in cut:
            for word in words:
                number.setdefault(word, len(number))
        encoded = self._replay.encode([w.encode() for w in number])
        ids = [[i for w in words for i in encoded[number[w]]] for words in cut]
        return np.array([i for some in ids for i in some], np.uint32), np.array(list(map(len, ids)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as uint32."""
        return self._memo.ids(texts)

    def decode(self, ids: list[int]) -> bytes:
        token = self._token
        return b"".join([token[i] for i in ids])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, made once (a pure function of the file)."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of what they decode to."""

    def run(batch: pa.RecordBatch):
        coder = codec(path, pattern)
        for block in text_blocks(batch):
            n, ids_sha, text_sha = [], [], []
            for got in coder.encode(texts_of(block)):
                ids = got.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, ENCODED)
