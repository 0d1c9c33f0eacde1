"""Text cut where no byte-level pre-token can cross, and a memo of what the
pieces become.

The pattern of the byte-level vocabularies never joins a character with a
white-space character behind it, nor a letter with the ASCII punctuation
behind it (the apostrophe aside).  Cutting there once, quickly, leaves pieces
that tokenise alone as they do inside the text, and that repeat often.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: White space as Unicode's property has it (what \s means to both libraries).
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
_STOP = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation but the apostrophe
PIECE = re.compile(
    f" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?![^{SPACE}{_STOP}])"
    f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

#: Pieces remembered by one Python worker (about 150 MB); then it starts anew.
MEMO_PIECES = 800_000

#: New pieces in, all their ids and how many each piece has out.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class PieceMemo:
    """What pieces become, filled by `encode` for many new pieces at once.

    A block of texts is cut, its distinct pieces are looked up (or encoded
    and put behind the others in one pool of ids), and the ids of all texts
    are gathered from the pool."""

    def __init__(self, encode: Encoder, limit: int = MEMO_PIECES):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._pool = np.zeros(1 << 16, np.uint32)
        self._start = np.zeros(1 << 14, np.int64)  # of each piece in the pool, and the end of the last

    def _learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        ids, sizes = self._encode(pieces)
        n, end = len(self._number), int(self._start[len(self._number)])
        while len(self._pool) < end + len(ids):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while len(self._start) < n + len(pieces) + 1:
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
        self._pool[end:end + len(ids)] = ids
        self._start[n + 1:n + 1 + len(pieces)] = end + np.cumsum(sizes)
        self._number.update(zip(pieces, range(n, n + len(pieces))))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, as uint32."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            pieces += PIECE.findall(text)
            ends.append(len(pieces))
        if not pieces:
            return [np.zeros(0, np.uint32) for _ in texts]
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._number) > self._limit:
            self._clear()
        known = np.fromiter(map(self._number.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        known[new] = np.arange(len(self._number), len(self._number) + len(new))
        self._learn([distinct[i] for i in new.tolist()])
        number = known[coded.indices.to_numpy()]
        start = self._start[number]
        size = self._start[number + 1] - start
        at = np.concatenate([[0], np.cumsum(size)])
        out = self._pool[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
        cuts = at[ends]
        return [out[a:z] for a, z in zip(cuts, cuts[1:])]
