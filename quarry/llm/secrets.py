"""Secret scan with assignment-aware lexing.

The base kinds are patterns over the whole text: `assign` (a sensitive word,
an assignment sign and a value), `access` (access key ids) and `hex` (long
runs of hexadecimal digits).

The lexer reads source and configuration syntax: every line with an
assignment sign is cut into strings, names and signs, and gives name-literal
pairs (`NAME = "..."`, `name: value`, `"name" => '...'`, `name: type = "..."`,
`export NAME=value`, `<name>value</name>`, `map["name"] = "..."`).  A type may
have brackets, a string a prefix (`b"..."`) or three quotes, and a value may
stand on the lines behind its sign.  Literals joined by `+`, or side by side
in round brackets, are one value.  A name that stands for earlier literals passes them on, so a constant
with a harmless name is found when a sensitive one receives it.  A pair's
score adds what the words of the target name say to what the literal looks
like; pieces of a literal that reach the threshold are spans of kind `lexed`.
They are added; base spans always stay.

Defined results: a null text counts as empty and has no spans; spans are
half-open, in code points; ties in start go by kind; repeated rows repeat; an
empty table gives an empty one.  The scan leaves other columns behind; the
redaction keeps all of them.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import column, map_arrow, text_blocks, texts_of

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # whole runs of 16 or more
MARK = "[REDACTED]"

# What the words of a name say about its value.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 2, "apikey": 3, "credential": 3,
    "credentials": 3, "private": 1, "access": 1, "auth": 1, "api": 1, "bearer": 2, "signing": 1, "encryption": 1, "key": 1,
    "public": -3, "count": -3, "length": -3, "limit": -3, "max": -2, "min": -2, "file": -2, "path": -2, "url": -2,
    "name": -2, "type": -2, "hint": -2, "label": -2, "field": -2, "expiry": -2, "ttl": -2,
}
NEEDED_NAME, NEEDED_SCORE = 2, 5
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your[_-]|dummy|redacted|xxxx|\*\*\*|^<.*>$|\$\{|\{\{|%\(")

_SIGN = re.compile("[=:>]")
_TOKEN = re.compile(r"""(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
                    r"""|(?P<sign>:=|=>|[=!<>]=|[=:])|(?P<plus>\+)|(?P<end>[;,()\[\]{}])"""
                    r"""|(?P<word>[^\s"'`=:+;,()\[\]{}]+)|(?P<quote>["'`])""")
_BARE = re.compile(r"""[^\s"'`;,()\[\]{}]+""")
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*")
_TAG = re.compile(r"<([A-Za-z_][\w.-]*)>([^<\n]+)</\1>")
_PREFIX = r"(?:(?i:[bfrultnexsc]|br|rb|fr|rf|tr|rt|lr|ur|u8|u8r)#*|[@$]{1,2})"
_GLUED = re.compile(_PREFIX + r"""(?=["'`])""")  # letters that belong to the string behind them
_KEY = re.compile(r"[^\S\n]*(?:=>|:|=(?!=))")  # what stands behind a name
_CHAIN = re.compile(r"[^\S\n]*(?:=>|=(?![=>]))(?=[^\S\n]*[^\s,;)}\]])")
_ATOM = re.compile(r"""[&*]*(?:'\w+\s+)?(?:(?:mut|const|dyn)\s+)?[A-Za-z_][\w.]*(?:::[A-Za-z_][\w.]*)*|"[^"\n]*"|'[^'\n]*'""")
_UNION = re.compile(r"[?!]?[^\S\n]*\|[^\S\n]*")
_EQUALS = re.compile(r"[?!]?(?:[^\S\n]+(?==(?![=>]))|(?==(?![=>])[^\S\n]*" + _PREFIX + r"""?["'`]))""")
_QUOTED_TYPE = re.compile(r"[^\S\n]*=(?![=>])[^\S\n]*" + _PREFIX + r"""?["'`]""")
_BLOCK = re.compile(r"[|>][+-]?\d?(?=[^\S\n]*\n)")  # YAML's block scalars
# The next line when a value is pending: a string that is no key, or one word alone; with + in front, a string or a name.
_NEXT = re.compile(r"""\s*(?P<plus>\+\s*)?(?:(?P<str>""" + _PREFIX + r"""?(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))"""
                   r"""(?![^\S\n]*(?:=>|:|=(?!=)))|(?P<word>[^\s"'`;,()\[\]{}:=]+=*)[^\S\n]*[;,)]*[^\S\n]*(?=\n|\Z))""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

Piece = tuple[int, int]


def name_score(name: str) -> int:
    """Sum of the weights of the words in a name, however they are joined."""
    return sum(NAME_WEIGHTS.get(w.lower(), 0) for w in _PARTS.findall(name))


class Value:
    """A literal, or what several values give side by side.

    Values are shared, never copied: a name that stands for another's value
    points at it.  What the score needs is additive, so it is worked out once
    for each value from its parts, and its spans are gathered once at the end,
    however often a constant is joined with itself."""

    __slots__ = ("span", "parts", "counts", "flags")

    def __init__(self, span: Piece | None = None, parts: tuple[Value, ...] = ()):
        self.span, self.parts = span, parts
        self.counts: np.ndarray | None = None  # of code points, by their last seven bits
        self.flags: set[str] = set()

    def read(self, literal: str) -> None:
        self.counts = np.bincount(np.frombuffer(literal.encode("utf-32-le"), np.uint32) & 127, minlength=128).astype(np.float32)
        self.flags = {name for name, f in CHARACTERS.items() if any(map(f, literal))}
        if PLACEHOLDER.search(literal):
            self.flags.add("placeholder")

    def weigh(self, text: str) -> None:
        """Counts and flags of this value and of those it is made of."""
        waiting = [self]
        while waiting:
            value = waiting[-1]
            if value.counts is not None:
                waiting.pop()
            elif value.span is not None:
                value.read(text[slice(*value.span)])
            elif unread := [p for p in value.parts if p.counts is None]:
                waiting += unread
            else:
                value.counts = sum(p.counts for p in value.parts)
                if value.counts.sum() > 1e30:  # a constant doubled a hundred times
                    value.counts /= np.float32(1e20)
                value.flags = set().union(*(p.flags for p in value.parts))

    def score(self) -> int:
        """Length, entropy and mix of characters against prose and placeholders."""
        n = self.counts.sum()
        if n < 8 or "placeholder" in self.flags:
            return -9
        shares = self.counts[self.counts > 0] / n
        entropy = -float((shares * np.log2(shares)).sum())
        kinds = len(self.flags & {"lower", "upper", "digit"})
        return int(n >= 12) + (entropy >= 2.9) + (kinds >= 2) - 2 * ("space" in self.flags) - 2 * (kinds < 2)


CHARACTERS = {"lower": str.islower, "upper": str.isupper, "digit": str.isdigit, "space": str.isspace}


def literal_score(literal: str) -> int:
    value = Value()
    value.read(literal)
    return value.score()


class Lexer:
    """The name-literal pairs of one text, with constants passed on."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, Value] = {}
        self._secret: list[Value] = []
        self._closing: dict[int, int] | None = None
        self._untyped = 0  # no annotation begins before this place
        at = 0
        while sign := _SIGN.search(text, at):
            at = self._line(text.rfind("\n", 0, sign.start()) + 1, self._end(sign.end()))

    def _end(self, at: int) -> int:
        """The end of the line."""
        end = self.text.find("\n", at)
        return len(self.text) if end < 0 else end

    def _close(self, at: int) -> int:
        """Where the bracket that opens at `at` is closed, or -1."""
        if self._closing is None:
            self._closing = {}
            for opening, both in ("[", r"[\[\]]"), ("<", r"[<>]"):
                held: list[int] = []
                for m in re.finditer(both, self.text):
                    if m[0] == opening:
                        held.append(m.start())
                    elif held:
                        self._closing[held.pop()] = m.start()
        return self._closing.get(at, -1)

    def _annotated(self, at: int) -> int:
        """The place of the = behind an annotation that begins at `at`, or -1:
        names with brackets of any depth, joined by |."""
        if at < self._untyped:
            return -1
        text, plain = self.text, True
        while atom := _ATOM.match(text, at):
            at = atom.end()
            while text[at:at + 1] in ("[", "<"):
                at, plain = self._close(at) + 1, False
                if not at:
                    return -1
            if equals := _EQUALS.match(text, at):
                return equals.end()
            if not (union := _UNION.match(text, at)):
                break
            at = union.end()
        if plain:
            self._untyped = at
        return -1

    def found(self) -> set[Piece]:
        """The spans of all literals that secrets are made of."""
        seen, waiting = set(map(id, self._secret)), list(self._secret)
        for value in waiting:
            fresh = [p for p in {id(p): p for p in value.parts}.values() if id(p) not in seen]
            seen.update(map(id, fresh))
            waiting += fresh
        return {value.span for value in waiting if value.span is not None}

    def _give(self, targets: list[str], pieces: list[Value]) -> None:
        if not pieces:
            return
        value = pieces[0] if len(pieces) == 1 else Value(parts=tuple(pieces))
        for name in targets:
            self.known[name] = value
        name = max(map(name_score, targets))
        if name >= NEEDED_NAME:
            value.weigh(self.text)
            if name + value.score() >= NEEDED_SCORE:
                self._secret.append(value)

    def _line(self, at: int, end: int) -> int:
        """Lexes a line, and the next ones while a value is pending; returns
        the end of the last."""
        text = self.text
        for tag in _TAG.finditer(text, at, end):
            self._give([tag[1]], [Value(tag.span(2))])
        targets: list[str] = []  # names that wait for a value
        last = ""  # a name that a sign may follow
        pieces: list[Value] = []
        before: list[str] = []  # names before the brackets that are open
        joined = signed = colon = grouped = False
        while True:
            token = _TOKEN.search(text, at)
            if token is None or token.start() >= end:
                follows = _NEXT.match(text, end) if signed else None
                if follows is None:
                    break
                word = follows["word"]
                if follows["plus"]:
                    if not pieces or (word and word not in self.known):
                        break
                    joined = True
                elif not joined and not (grouped and follows["str"]):
                    break
                begin, end = end, self._end(follows.end())
                for tag in _TAG.finditer(text, begin, end):
                    self._give([tag[1]], [Value(tag.span(2))])
                continue
            kind, at = token.lastgroup, token.end()
            if kind == "sign" and token[0] in ("=", ":", ":=", "=>"):
                if signed and pieces and not last:
                    self._give(targets, pieces)
                    targets = []
                if not signed or (grouped and not last):
                    targets = []
                if last:
                    targets.append(last)
                signed, pieces, last, joined, colon, grouped = bool(targets), [], "", True, token[0] == ":", False
            elif kind == "plus":
                joined = True
            elif kind == "str":
                span = (token.start() + 1, token.end() - 1)
                if signed and joined and not pieces and token[0] in ('""', "''") and text[at:at + 1] == token[0][0]:
                    close = text.find(token[0][0] * 3, at + 1)
                    if close >= 0:  # three quotes
                        self._give(targets, [Value((at + 1, close))])
                        if close > end:  # its lines are read too
                            targets, signed, last, joined, at = [], False, "", False, at + 1
                            continue
                        span, at = (at + 1, close), close + 3
                content = text[slice(*span)]
                if signed and colon and joined and not pieces and _QUOTED_TYPE.match(text, at):
                    continue
                elif signed and (joined or grouped) and not (grouped and _NAME.fullmatch(content) and _KEY.match(text, at)):
                    pieces.append(Value(span))
                    last, joined = "", False
                    if _NAME.fullmatch(content) and text[at:at + 1] == ":":
                        last = content
                else:
                    self._give(targets, pieces) if signed else None
                    targets, signed, pieces = [], False, []
                    last = content if _NAME.fullmatch(content) else ""
            elif kind == "word" and signed and token[0] == "\\" and text[at:at + 2].lstrip("\r")[:1] == "\n":
                joined = joined or bool((follows := _NEXT.match(text, at)) and follows["str"])  # the line goes on
            elif kind == "word" and signed and joined and not (grouped and _NAME.fullmatch(token[0]) and _KEY.match(text, at)):
                word = token[0]
                if (glued := _GLUED.match(text, token.start())) and glued.end() == at:
                    continue
                if _NAME.fullmatch(word) and not pieces and _CHAIN.match(text, at):
                    last, joined = word, False  # another name, or a type between the name and its value
                elif colon and not pieces and (equals := self._annotated(token.start())) >= 0:
                    at, end = equals, max(end, self._end(equals))  # a longer type
                elif word in self.known:
                    pieces.append(self.known[word])
                    last, joined = "", False
                elif colon and not pieces and _BLOCK.match(text, token.start()):
                    continue
                else:
                    bare = _BARE.match(text, token.start(), end)
                    at = bare.end()
                    pieces.append(Value(bare.span()))
                    last, joined = "", False
            elif token[0] == "(" and signed and joined and not pieces:
                grouped = True
            elif kind == "word" or kind == "end":
                if signed:
                    self._give(targets, pieces)
                name, open_name = "", last
                if kind == "word":
                    name = token[0] if _NAME.fullmatch(token[0]) else ""
                elif token[0] == "[":
                    before.append(open_name)
                elif token[0] == "]" and before:
                    owner = before.pop()
                    if owner:  # the key or the name before the bracket, what says more
                        name = max(open_name, owner, key=name_score) if open_name else owner
                    elif text[token.start() - 1] in "\"'`":
                        name = open_name
                targets, signed, pieces, joined, grouped, last = [], False, [], False, False, name
        if signed:
            self._give(targets, pieces)
        return end


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind), base kinds and lexed ones, in order."""
    spans = []
    signs = "=" in text or ":" in text
    if signs:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if signs or "</" in text:
        spans += [(a, z, "lexed") for a, z in Lexer(text).found()]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


DIGEST = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_lexed bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Counts of the kinds, the hash of the base spans and all spans."""

    def run(batch: pa.RecordBatch):
        for block in text_blocks(batch):
            found = [find(t) for t in texts_of(block)]
            counts = [Counter(kind for _, _, kind in spans) for spans in found]
            base = [hashlib.sha256(_joined([s for s in spans if s[2] != "lexed"]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id").cast(pa.int64()), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS],
                 pa.array(base, pa.string()), pa.array(list(map(_joined, found)), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, DIGEST)


def redacted(text: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, z, _ in find(text):
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, z)
    return "".join([*out, text[at:]]) if out else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """All documents with their secrets taken out; n_chars, where there is
    one, counts the new text.  A null text stays null."""
    names = docs.columns

    def run(batch: pa.RecordBatch):
        at = names.index("text")
        for block in text_blocks(batch):
            texts = [None if t is None else redacted(t) for t in block.column(at).to_pylist()]
            arrays = list(block.columns)
            arrays[at] = pa.array(texts, block.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = arrays[k].to_pylist()
                was = block.column(at).to_pylist()
                arrays[k] = pa.array([o if t == w else len(t) for o, t, w in zip(old, texts, was)], block.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=block.schema)

    return map_arrow(docs, run, docs.schema)
