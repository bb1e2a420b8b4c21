"""Language-model scoring with an Elias-Fano n-gram trie.

The trie's levels are files in the shared folder, which workers memory-map.
Level 1 is the vocabulary: sorted word hashes and running counts, each as an
Elias-Fano sequence; a word's id is its place. Level k holds, for each node of
level k-1 as context, the successors seen after it: monotone pointers to each
context's range, successor ids made monotone by adding what the range before
ends with, so that a successor is found by a search relative to its context,
and quantised probabilities. Levels are cut into files by ranges of contexts;
a node's number is its file's first number plus its place, and is the context
of the next level, so no level repeats its keys.

Probabilities are interpolated absolute discounting: each level keeps the
discounted share of a successor and the weight its context leaves to the
level below; the lowest level is add-one over the vocabulary and one unknown.
The discount is one a level, from its n-grams of all files that occur once and
twice: files are written with counts first, and again with probabilities.

Counts never meet as rows of n-grams: tasks count within slices and ship
sorted, packed blocks by file; a file's task merges the blocks. Its memory
follows the file (``nodes``) or the successors of one context, if larger.

Defined results: a null text is the end token alone; a null key counts as
training; repeated rows count again; with no training tokens every word has
the probability of an unknown one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm import eliasfano, hashing
from gradeweave.llm.common import arrow_map, attempt_name, materialize, new_dir, read_buffer, remove, rows_by_bytes, shuffle_partitions, write_bytes

_U = np.uint64
BOS, END, FIRST = 0, 1, 2  # ids; words follow
SLICE = 4 << 20
NODES = 2_000_000  # of a file, about
CODES = 4096  # quantised probabilities: steps of the logarithm
LEAST = 1e-12


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 is zero."""
    step = np.rint((1 - np.log(np.maximum(p, LEAST)) / np.log(LEAST)) * (CODES - 2))
    return np.where(p <= 0, 0, np.clip(step, 0, CODES - 2) + 1).astype(np.uint16)


DECODE = np.concatenate(([0.0], np.exp((1 - np.arange(CODES - 1) / (CODES - 2)) * np.log(LEAST))))


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """Arrays in one file, each aligned for memory mapping."""
    head, at = {}, 0
    for name, x in parts.items():
        head[name] = (at, x.dtype.str, len(x))
        at += -(-x.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    out = [struct.pack("<Q", len(text)), text]
    for x in parts.values():
        out += [x.tobytes(), b"\0" * (-x.nbytes % 64)]
    return b"".join(out)


def unpack(buffer) -> dict[str, np.ndarray]:
    (n,) = struct.unpack("<Q", buffer[:8])
    head = json.loads(bytes(buffer[8 : 8 + n]))
    return {k: np.frombuffer(buffer, np.dtype(d), c, 8 + n + at) for k, (at, d, c) in head.items()}


def _named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in arrays.items()}


def _sequence(arrays: dict[str, np.ndarray], name: str) -> eliasfano.EliasFano:
    return eliasfano.EliasFano({k.split(".", 1)[1]: v for k, v in arrays.items() if k.startswith(f"{name}.")})


def _places(keys: np.ndarray) -> np.ndarray:
    """Places of unsigned keys in ascending order; keys and places are sorted as one number where they fit."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) >> (64 - bits) == 0:
        both = np.sort(keys << _U(bits) | np.arange(len(keys), dtype=np.uint64))
        return (both & _U((1 << bits) - 1)).astype(np.int64)
    return np.argsort(keys)


class Files:
    """The files of a level, opened (mapped) when first asked for."""

    def __init__(self, manifest: list[tuple]):
        self.low = np.array([m[0] for m in manifest], np.uint64)  # first hash or context of each file
        self.base = np.array([m[1] for m in manifest], np.int64)  # number of its first node
        self.paths, self.opened = [m[2] for m in manifest], {}

    def __getitem__(self, k: int) -> dict:
        if k not in self.opened:
            arrays = unpack(read_buffer(self.paths[k]))
            self.opened[k] = {n: _sequence(arrays, n) for n in {a.split(".")[0] for a in arrays if "." in a}} | {a: v for a, v in arrays.items() if "." not in a}
        return self.opened[k]

    def dealt(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(file, places of the keys that lie in it); keys in any order."""
        if not len(self.low) or not len(keys):
            return
        file = np.searchsorted(self.low, keys, "right") - 1
        order = _places(keys)
        file = file[order]
        starts = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(file)).tolist()):
            if file[a] >= 0:
                yield int(file[a]), order[a:b]


class Trie:
    """Lookups in levels 1 to len(levels)."""

    def __init__(self, words: list[tuple], levels: list[list[tuple]], total: int, distinct: int):
        self.words, self.levels = Files(words), [Files(m) for m in levels]
        self.total, self.distinct = total, distinct

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each word."""
        found, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        unique, inverse = np.unique(hashes, return_inverse=True)
        ids, c = np.full(len(unique), -1), np.zeros(len(unique), np.int64)
        for k, at in self.words.dealt(unique):
            file = self.words[k]
            place = file["hash"].find(unique[at])
            hit = place >= 0
            at, place = at[hit], place[hit]
            upto = file["sum"][place].astype(np.int64)
            before = np.where(place > 0, file["sum"][np.maximum(place - 1, 0)].astype(np.int64), 0)
            ids[at] = self.words.base[k] + place
            c[at] = upto - before
        found, counts = ids[inverse], c[inverse]
        return found, counts

    def step(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, share, weight left to the level below) of each successor in its context; contexts of -1 are unknown."""
        files = self.levels[level - 2]
        node, share, rest = np.full(len(context), -1), np.zeros(len(context)), np.ones(len(context))
        known = np.flatnonzero(context >= 0)
        for k, at in files.dealt(context[known].astype(np.uint64)):
            at = known[at]
            file = files[k]
            c = context[at] - int(files.low[k])
            inside = c < file["pointer"].n - 1
            at, c = at[inside], c[inside]
            if not len(at):
                continue
            # contexts come in order: each is looked up once
            new = np.concatenate(([True], c[1:] != c[:-1]))
            each, of = c[new], np.cumsum(new) - 1
            begin, stop = (x.astype(np.int64) for x in file["pointer"].pair(each))
            base = np.where(begin > 0, file["next"][np.maximum(begin - 1, 0)] if file["next"].n else _U(0), _U(0))
            rest[at] = np.where(stop > begin, DECODE[file["rest"][each]], 1.0)[of]
            wanted = np.flatnonzero((word[at] >= 0) & (stop > begin)[of])
            at, of = at[wanted], of[wanted]
            start, end, before = begin[of], stop[of], base[of]
            place = file["next"].find(before + word[at].astype(np.uint64))
            hit = (place >= start) & (place < end)
            at, place = at[hit], place[hit]
            node[at] = files.base[k] + place
            share[at] = DECODE[file["share"][place]]
        return node, share, rest


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner, first) with a place for the end token after each text; its hash is 0."""
    hashes, first, *_ = hashing.words(texts, lower=True)
    sizes = np.diff(first) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros(starts[-1], np.uint64)
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = np.where(hashes == 0, _U(1), hashes)
    return out, owner, starts


def _before(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each token's previous id; the begin id at a text's start."""
    out = np.concatenate(([BOS], ids[:-1])) if len(ids) else ids
    out[starts[:-1]] = BOS
    return out


def _word_ids(trie: Trie, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = trie.ids(hashes)
    return np.where(ids >= 0, np.where(hashes == 0, END, ids + FIRST), -1), counts


def _contexts(trie: Trie, ids: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """The level's context of each token: a node of the level below."""
    context = _before(ids, starts)
    for k in range(2, level):
        # the node that the previous token reached in level k
        node, _, _ = trie.step(k, context, ids)
        context = np.concatenate(([-1], node[:-1])) if len(node) else node
        context[starts[:-1]] = -1
    return context


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["h", "c"])

    for whole in batches:
        for batch in rows_by_bytes(whole, "text", SLICE):
            h, _, _ = tokens(batch.column("text").to_pylist())
            w, c = np.unique(h, return_counts=True)
            words, at = np.unique(np.concatenate((words, w)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, c)), len(words)).astype(np.int64)
            if len(words) > NODES:
                yield rows()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield rows()


def _word_files(parts: int, out_dir: str):
    """Rows (part, h, c), parts together, to a file for each part."""

    def write(part: int, h: np.ndarray, c: np.ndarray) -> tuple:
        order = np.argsort(h)
        h, c = h[order], c[order]
        path = f"{out_dir}/words-{part}-{attempt_name()}.ef"
        write_bytes(path, pack(_named("hash", eliasfano.build(h)) | _named("sum", eliasfano.build(np.cumsum(c)))))
        return part, path, len(h), int(c.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            part, h, c = (batch.column(k).to_numpy() for k in ("part", "h", "c"))
            for p in np.unique(part).tolist():
                mine = part == p
                held.setdefault(p, []).append((h[mine].view(np.uint64), c[mine]))
        for p in list(held):
            yield _manifest_row(write(p, *(np.concatenate(x) for x in zip(*held.pop(p)))))

    return run


MANIFEST = "part int, path string, n bigint, total bigint"


def _manifest_row(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "n", "total"])


def _cuts(contexts: int, parts: int) -> np.ndarray:
    """First context of each part."""
    return (np.arange(parts, dtype=np.float64) * contexts / parts).astype(np.int64)


def _order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places in order of context, then word: by one number of both where it fits."""
    if not len(context):
        return np.zeros(0, np.int64)
    low, span = int(context.min()), int(word.max()) + 1
    if (int(context.max()) - low + 1) * span < 1 << 63:
        return _places(((context - low) * span + word).astype(np.uint64))
    return np.lexsort((word, context))


def _count_grams(shared, level: int, cuts: np.ndarray):
    """Blocks of (context, successor, count), sorted, one for each slice and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, squeeze = Trie(*shared.value), zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", SLICE):
                h, _, starts = tokens(batch.column("text").to_pylist())
                ids, _ = _word_ids(trie, h)
                context = _contexts(trie, ids, starts, level)
                ok = (context >= 0) & (ids >= 0)
                context, word = context[ok], ids[ok]
                if not len(context):
                    continue
                order = _order(context, word)
                context, word = context[order], word[order]
                at = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]))))
                count = np.diff(np.append(at, len(context)))
                context, word = context[at], word[at]
                bounds = np.append(np.searchsorted(context, cuts), len(context))
                parts = np.flatnonzero(np.diff(bounds))
                data = [squeeze(_columns(np.diff(context[a:b], prepend=cuts[p]), word[a:b], count[a:b])) for p, a, b in zip(parts.tolist(), bounds[parts].tolist(), bounds[parts + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["part", "block"])

    return run


def _columns(*columns: np.ndarray) -> bytes:
    """Byte planes of 64-bit columns: the empty high planes cost nothing once compressed."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _columns_back(data: bytes, k: int) -> list[np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(k, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel().astype(np.int64) for p in planes]


def _counted(low: int, contexts: int, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """One file of a level, with counts: contexts low to low + contexts."""
    order = _order(context, word)
    context, word, count = context[order], word[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]))))
    count = np.add.reduceat(count, at)
    context, word = context[at] - low, word[at]
    kinds = np.bincount(context, minlength=contexts)
    pointer = np.concatenate(([0], np.cumsum(kinds)))
    last = np.where(kinds > 0, word[np.maximum(pointer[1:] - 1, 0)], 0)
    base = np.concatenate(([0], np.cumsum(last)))[:-1]
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return _named("pointer", eliasfano.build(pointer)) | _named("next", eliasfano.build(base[context] + word)) | {"count": small(count), "kinds": small(kinds)}


def _discount(once: int, twice: int) -> float:
    """Of a level, by how many of its n-grams occur once and twice."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _discounted(parts: dict[str, np.ndarray], discount: float) -> dict[str, np.ndarray]:
    """The file with probabilities in place of counts."""
    parts = dict(parts)
    count, kinds = parts.pop("count").astype(np.int64), parts.pop("kinds").astype(np.int64)
    context = np.repeat(np.arange(len(kinds)), kinds)
    totals = np.bincount(context, count, len(kinds))
    share = np.maximum(count - discount, 0) / totals[context]
    rest = discount * kinds / np.maximum(totals, 1)
    return parts | {"share": quantise(share), "rest": quantise(rest)}


def _discounted_files(discount: float, level: int, out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{out_dir}/level{level}-{r['part']}-{attempt_name()}.ef"
                write_bytes(path, pack(_discounted(unpack(read_buffer(r["path"])), discount)))
                yield _manifest_row((r["part"], path, r["n"], r["total"]))

    return run


def _level_files(cuts: np.ndarray, contexts: int, level: int, out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, b in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                held.setdefault(p, []).append(b)
        ends = np.append(cuts[1:], contexts)
        open_ = zstandard.ZstdDecompressor().decompress
        for p in list(held):
            parts = []
            for b in held.pop(p):
                delta, word, count = _columns_back(open_(b), 3)
                parts.append((np.cumsum(delta) + cuts[p], word, count))
            context, word, count = (np.concatenate(x) for x in zip(*parts))
            del parts
            made = _counted(int(cuts[p]), int(ends[p] - cuts[p]), context, word, count)
            path = f"{out_dir}/counts{level}-{p}-{attempt_name()}.ef"
            write_bytes(path, pack(made))
            row = _manifest_row((p, path, len(made["count"]), int(count.sum())))
            for name, times in (("once", 1), ("twice", 2)):
                row = row.append_column(name, pa.array([int((made["count"] == times).sum())], pa.int64()))
            yield row

    return run


def fit(docs: DataFrame, order: int = 3, text: str = "text"):
    """Count, build and write the levels; returns what ``Trie`` takes (a row a file)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    out_dir, least = new_dir(spark, "ngrams"), shuffle_partitions(spark)
    words = materialize(docs.transform(arrow_map, _count_words, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "ngram-words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n = max(1, distinct // NODES)
    top = F.shiftrightunsigned("h", 40).cast("long")
    dealt = words.withColumn("part", F.shiftright(top * n, 24).cast("int")).repartition(n, "part")
    files = materialize(dealt.transform(arrow_map, _word_files(n, out_dir), MANIFEST), "ngram-manifest").orderBy("part").collect()
    cuts = [-(-(p << 24) // n) << 40 for p in range(n)]
    level1, base = [], 0
    for f in files:
        level1.append((cuts[f.part], base, f.path))
        base += f.n
    levels: list[list[tuple]] = []
    contexts = distinct + FIRST
    for level in range(2, order + 1):
        shared = spark.sparkContext.broadcast((level1, levels, total, distinct))  # names of files
        parts = max(least, int(total // NODES)) if total else 1
        starts, counts_dir = _cuts(contexts, max(1, min(parts, contexts))), new_dir(spark, "ngram-counts")
        blocks = docs.transform(arrow_map, _count_grams(shared, level, starts), "part int, block binary").repartition(len(starts), "part")
        counted = materialize(blocks.transform(arrow_map, _level_files(starts, contexts, level, counts_dir), f"{MANIFEST}, once bigint, twice bigint"), "ngram-counted")
        once, twice = counted.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
        final = counted.drop("once", "twice").repartition(len(starts), "part").transform(arrow_map, _discounted_files(_discount(once, twice), level, out_dir), MANIFEST)
        files = materialize(final, "ngram-manifest").orderBy("part").collect()
        remove(spark, counts_dir)  # the files with probabilities are all written
        made, base = [], 0
        for f in files:
            made.append((int(starts[f.part]), base, f.path))
            base += f.n
        levels = [*levels, made]
        contexts = base
    return level1, levels, int(total), int(distinct)


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score (log10) to the rows' other columns; ``text`` leaves, and so do columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of files
    made_ = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    keep = [c for c in docs.columns if c != text and c.lower() not in made_]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
    for name, kind in made_.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*shared.value)
        for whole in batches:
            for batch in rows_by_bytes(whole, text, SLICE):
                n = batch.num_rows
                h, owner, starts = tokens(batch.column(batch.schema.get_field_index(text)).to_pylist())
                ids, counts = _word_ids(trie, h)
                p1 = (counts + 1) / (trie.total + trie.distinct + 1)
                p, context = p1, _before(ids, starts)
                for level in range(2, len(trie.levels) + 2):
                    node, share, rest = trie.step(level, context, ids)
                    p = share + rest * p
                    context = np.concatenate(([-1], node[:-1])) if len(node) else node
                    context[starts[:-1]] = -1
                sums = [np.bincount(owner, w, n) for w in (np.log10(p1), np.log10(p))]
                made = [pa.array(np.diff(starts), pa.int64()), pa.array(np.bincount(owner, counts > 0, n).astype(np.int64)), pa.array(np.full(n, trie.total), pa.int64()), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + made, names=schema.names)

    return docs.transform(arrow_map, run, schema)
