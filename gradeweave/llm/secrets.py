"""Secret scans over a trigram inverted index.

Each rule's regex becomes a Boolean query of the trigrams every match must
hold. An index of a shard of texts (folded to lower case) maps trigrams to
posting lists; a rule's query intersects and unites them, and its regex runs
on the candidates only. Rules without mandatory trigrams scan every text of
the shard. Shards are slices of Arrow batches: map-only, memory follows a slice,
or one text if that is longer.

Spans are in code points, end exclusive, ordered by start, then by the rules'
order. Defined results: a null or empty text has no spans; repeated rows get
the same spans; other columns pass through, but one named ``spans`` (or
``redacted``) is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradeweave.llm.common import arrow_map, rows_by_bytes

MOST_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    shortest: int = 0  # characters of ``group``
    group: int = 0


#: The three base kinds, in their order.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: A key block through its END line; without one, through the header lines and the base64 that follow. Line ends may be escaped.
_LINE_END = r"(?:\s|\\[nr])"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_LINE_END}++(?:Proc-Type|DEK-Info|Comment|Version): ?[^\r\n\\]*+)*+"
    rf"(?:{_LINE_END}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:(?<=[A-Za-z0-9+/]{{16}}){_LINE_END}++(?:[A-Za-z0-9+/]{{1,15}}+={{1,2}}+|[A-Za-z0-9+/]{{1,15}}+(?=[\r\n\\\"'<]|\Z)))?)"
)
MORE = (
    Rule("private_key", PRIVATE_KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+"),  # a run is tried at its begin alone
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{1,128}@"),
)

# A query is None (no demand), a trigram, or ("and" | "or", queries).


def _join(op: str, parts) -> object:
    parts = list(dict.fromkeys(parts))
    if op == "or" and any(p is None for p in parts):
        return None
    parts = [p for p in parts if p is not None]
    if len(parts) < 2:
        return parts[0] if parts else None
    return (op, tuple(parts))


def _fold(s: str) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in s.encode())


def _demand(strings: set[bytes]) -> object:
    """One of the strings must occur."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass
class _Part:
    """What a piece of a regex matches: all its strings, or how they begin and end, and a demand."""

    all: set[bytes] | None
    first: set[bytes]
    last: set[bytes]
    demand: object = None


def _any() -> _Part:
    return _Part(None, {b""}, {b""})


def _strings(s: set[bytes]) -> _Part:
    return _Part(s, s, s)


def _cut(s: set[bytes], keep) -> set[bytes]:
    for n in (8, 3, 2):
        if len(s) <= MOST_STRINGS:
            return s
        s = {keep(x, n) for x in s}
    return s if len(s) <= MOST_STRINGS else {b""}


def _then(a: _Part, b: _Part) -> _Part:
    if a.all is not None and b.all is not None and len(a.all) * len(b.all) <= MOST_STRINGS:
        return _strings({x + y for x, y in product(a.all, b.all)})
    across = {x + y for x, y in product(_cut(a.last, lambda x, n: x[-n:]), _cut(b.first, lambda x, n: x[:n]))} if len(a.last) * len(b.first) <= MOST_STRINGS**2 else {b""}
    demand = _join("and", [a.demand, b.demand, _demand(across), *(_demand(p.all) for p in (a, b) if p.all is not None)])
    first = {x + y for x, y in product(a.all, b.first)} if a.all is not None and len(a.all) * len(b.first) <= MOST_STRINGS else a.first
    last = {x + y for x, y in product(a.last, b.all)} if b.all is not None and len(a.last) * len(b.all) <= MOST_STRINGS else b.last
    return _Part(None, first, last, demand)


def _either(parts: list[_Part]) -> _Part:
    if all(p.all is not None for p in parts) and sum(len(p.all) for p in parts) <= MOST_STRINGS:
        return _strings(set().union(*(p.all for p in parts)))
    demand = _join("or", [p.demand if p.all is None else _demand(p.all) for p in parts])
    return _Part(None, _cut(set().union(*(p.first for p in parts)), lambda x, n: x[:n]), _cut(set().union(*(p.last for p in parts)), lambda x, n: x[-n:]), demand)


#: Letters that match some character beyond ASCII where case is ignored.
_WIDE = frozenset("iksIKS")


def _one_of(codes, ignore_case: bool) -> _Part:
    chars = {chr(c) for c in codes}
    if ignore_case and any(not c.isascii() or c in _WIDE for c in chars):
        return _any()
    return _strings({_fold(c) for c in chars})


def _parse(tree, ignore_case: bool = False) -> _Part:
    out = _strings({b""})
    for op, arg in tree:
        if op is sre.LITERAL:
            part = _one_of([arg], ignore_case)
        elif op is sre.IN and all(o is sre.RANGE and a[1] - a[0] < 12 or o is sre.LITERAL for o, a in arg):
            part = _one_of([c for o, a in arg for c in (range(a[0], a[1] + 1) if o is sre.RANGE else [a])], ignore_case)
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            part = _parse(arg[3], ignore_case)
        elif op is sre.BRANCH:
            part = _either([_parse(x, ignore_case) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            one = _parse(inner, ignore_case)
            part = _strings({b""})
            for _ in range(min(int(least), 4)):
                part = _then(part, one)
            if most == least <= 4:
                pass
            elif least == 0 and most == 1 and one.all is not None:
                part = _strings(one.all | {b""})
            else:
                part = _then(part, _any())
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _strings({b""})
        else:
            part = _any()
        out = _then(out, part)
    return out


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a regex, over lower-cased bytes; None: no mandatory trigram."""
    tree = sre_parse.parse(pattern)
    part = _parse(tree, bool(tree.state.flags & re.IGNORECASE))
    return _demand(part.all) if part.all is not None else part.demand


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes whose trigrams are told apart at once.
CHUNK = 1 << 18


class TrigramIndex:
    """Posting lists of every trigram of some texts; built by chunks, so one long text takes little more than its distinct trigrams."""

    def __init__(self, texts: Sequence[bytes]):
        self.n = len(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        found = [np.zeros(0, np.uint64)]
        for lo in range(0, len(data) - 2, CHUNK):
            part = _LOWER[data[lo : lo + CHUNK + 2]].astype(np.uint32)
            code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.arange(lo, lo + len(code))
            doc = np.searchsorted(ends, at, "right")
            code = code[at + 2 < ends[doc]].astype(np.uint64) << np.uint64(32) | doc[at + 2 < ends[doc]].astype(np.uint64)
            found.append(np.unique(code))
        pairs = np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]
        codes = pairs >> np.uint64(32)
        self.codes, self.starts = np.unique(codes, return_index=True)
        self.starts = np.append(self.starts, len(pairs))
        self.docs = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def postings(self, trigram: bytes) -> np.ndarray:
        code = np.uint64(int.from_bytes(trigram, "big"))
        k = int(np.searchsorted(self.codes, code))
        if k == len(self.codes) or self.codes[k] != code:
            return np.zeros(0, np.int64)
        return self.docs[self.starts[k] : self.starts[k + 1]]

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings(query)
        op, parts = query
        if op == "or":
            return np.unique(np.concatenate([self.candidates(p) for p in parts]))
        found = self.candidates(parts[0])
        for p in parts[1:]:
            if not len(found):
                break
            found = np.intersect1d(found, self.candidates(p), assume_unique=True)
        return found


def finder(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
    """Leftmost non-overlapping matches, without those whose group is too short."""
    find, g, shortest = re.compile(rule.pattern).finditer, rule.group, rule.shortest
    if simple := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern):  # a run of one class: the short runs never match
        find = re.compile(f"{simple[1]}{{{max(1, shortest)},}}").finditer
    return lambda text: [m.span() for m in find(text) if m.end(g) - m.start(g) >= shortest]


def spans_of(texts: list[str], rules: Sequence[Rule], queries: Sequence, finders: Sequence) -> list[list[tuple[int, int, int]]]:
    """Per text, (start, rule's place, end) in order."""
    index = TrigramIndex([t.encode("utf-8", "surrogatepass") for t in texts])
    out: list[list] = [[] for _ in texts]
    for k, (query, find) in enumerate(zip(queries, finders)):
        for i in index.candidates(query).tolist():
            out[i] += [(a, k, b) for a, b in find(texts[i])]
    for x in out:
        x.sort()
    return out


def redact(text: str, spans: list[tuple[int, int, int]], kinds: Sequence[str]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind."""
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kinds[k]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(df: DataFrame, rules: Sequence[Rule] = BASE + MORE, text: str = "text", redacted: bool = False) -> DataFrame:
    """Add ``spans`` and, if asked for, ``redacted``: the text without its secrets (null stays null)."""
    rules = tuple(rules)
    more = [T.StructField("spans", SPANS), *([T.StructField("redacted", T.StringType())] if redacted else [])]
    names = {f.name for f in more}
    kept = [f for f in df.schema if f.name.lower() not in names]
    at = [i for i, f in enumerate(df.schema) if f.name.lower() not in names]
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, finders, kinds = [trigram_query(r.pattern) for r in rules], [finder(r) for r in rules], [r.kind for r in rules]
        for whole in batches:
            for batch in rows_by_bytes(whole, text):
                given = batch.column(batch.schema.get_field_index(text)).to_pylist()
                found = spans_of([t or "" for t in given], rules, queries, finders)
                flat = list(chain.from_iterable(found))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array([kinds[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())], fields=list(struct))
                made = [pa.ListArray.from_arrays(pa.array(offsets), values)]
                if redacted:
                    made.append(pa.array([None if t is None else redact(t, x, kinds) if x else t for t, x in zip(given, found)], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + made, names=[f.name for f in kept] + [f.name for f in more])

    return df.transform(arrow_map, run, T.StructType(kept + more))
