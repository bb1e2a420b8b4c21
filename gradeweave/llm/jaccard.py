"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document's set holds the hashes of its word shingles. Sets of similar size
share a band; two sets that link lie in one band or in neighbouring ones, and
their symmetric difference is at most H(band). Tokens are hashed into m
segments of the universe, and each band uses the cheapest of three indexes:

- ``one``: m = H+1+2z segments, of which H cannot match, so 2z+1 do; each set
  leaves out its z weakest segments (fewest tokens) and indexes the others;
- ``two``: m = H+2 segments, of which two match: pairs of segments are indexed;
- ``near``: m = (H+1)/2 segments, of which one differs by one token at most:
  each segment and all its one-deletion neighbours are indexed.

The cost of each is its number of signatures plus the expected candidates,
from the band's number of sets. Signatures travel in packed blocks, one for
each slice and partition, once for each distinct set of the slice: exact
copies meet at once. Buckets with two or more sets are the candidates.

Buckets never expand into all pairs: a first pass ties the sets of a bucket to
a few hubs (large buckets in cells side by side, whose hubs are tied in turn),
exact verification turns ties into links and components follow; a second pass
then compares only sets of a bucket that are still in different components, and
verifies what a bound leaves. So no link between different texts is lost: pairs
not verified are already connected. Unlike sets of one template share hundreds
of buckets, so the second pass first unites the buckets with the same least
component: a set is there once, and two sets meet once, in blocks. Ties are
bounded by a 128-bin histogram whose L1 distance is at most the difference, the
second pass by odd sketches (Mitzenmacher, Pagh and Pham, 2014): one bit a bin,
whether it holds an odd number of tokens, so that sets differ by as many tokens
at least as bits. Before the
sets themselves travel to be verified, a sketch with more bins, which follow
the size of the set, gives a tighter bound of the same kind: 128 bins tell
nothing of sets of some thousand shingles. Where the
number of links is asked for, the second pass takes all pairs of a bucket,
connected or not; that work grows with the square of a group of near copies.

Defined results: without words a set is empty and linked with nothing; a null
key takes no part and has itself (null) as component; repeated rows and exact
copies share a set; a text longer than a slice is a slice of its own, whole;
keys are longs, others are cast and an error where they can't be; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm import hashing
from gradeweave.llm.common import arrow_map, materialize, rows_by_bytes, shuffle_partitions
from gradeweave.llm.graph import components
from gradeweave.llm.sieve import sieve

BINS = 128
#: Bits of an odd sketch: the power of two from four times the set's size on, within these.
BITS = 1024, 16384
#: Bins of a sketch: one a token up to so many, then one for four tokens.
FINE = 1024
SLICE = 2 << 20
#: Signatures in a partition, about.
FULL = 1_000_000
#: Sets of a bucket, or of united ones, that are compared in one block with others.
BLOCK = 2048
#: Sets of a bucket in one row.
LIST = 4096
#: Chance that a shingle of one set is in an unlinked other, for the cost: about
#: four times the mean of 200,000 random pairs (0.0015 at three words, 0.0012 at
#: five). It decides how many sets a band holds before a larger index pays, not
#: what is found.
COMMON = 0.005
_U = np.uint64


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    hashes, first, *_ = hashing.words(texts, lower=True)
    whole = hashing.runs(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        else:
            out.append(hashing.runs(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """64-bit identity of a set, as a signed long."""
    return int(np.int64(hashing.mix(np.array([hashing.mix(s ^ _U(0x51ED270B)).sum(dtype=np.uint64) + _U(len(s))]))[0]))


def histogram(s: np.ndarray) -> bytes:
    """How many tokens fall into each bin, modulo 256."""
    return (np.bincount((s >> _U(57)).astype(np.int64), minlength=BINS) & 255).astype(np.uint8).tobytes()


def odd_sketch(s: np.ndarray) -> bytes:
    """A bit a bin, by the tokens' low bits, whether the bin holds an odd number of them; half of it folds onto the other."""
    bits = min(max(BITS[0], 1 << (4 * len(s) - 1).bit_length()), BITS[1])
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def sketch(s: np.ndarray) -> bytes:
    """The set's size in four bytes, then its histogram with a power of two of bins by that size."""
    bits = (max(BINS, min(len(s), FINE), -(-len(s) // 4)) - 1).bit_length()
    bins = np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) & 255
    return np.uint32(len(s)).astype("<u4").tobytes() + bins.astype(np.uint8).tobytes()


def near_sketches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sets of these sketches can link; the finer one is folded to the other's bins."""
    both = int(a[:4].view("<u4")[0]) + int(b[:4].view("<u4")[0])
    a, b = a[4:], b[4:]
    size = min(len(a), len(b))
    d = a.reshape(size, -1).sum(axis=1, dtype=np.uint8) - b.reshape(size, -1).sum(axis=1, dtype=np.uint8)
    return int(np.minimum(d, -d).sum(dtype=np.int64)) * (100 + percent) <= (100 - percent) * both


@dataclass(frozen=True)
class Band:
    """Sizes low to high; at most ``most`` tokens between linked sets whose larger is in it."""

    low: int
    high: int
    most: int
    kind: str = "one"
    m: int = 1
    skip: int = 0

    def signatures(self) -> float:
        return {"one": self.m - self.skip, "two": self.m * (self.m - 1) / 2, "near": self.m + self.high}[self.kind]


def bands(largest: int, percent: int) -> list[Band]:
    out, low = [], 1
    while low <= largest:
        high = max(low, low * 100 // percent)
        out.append(Band(low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


def allocate(band: Band, sets: int, kinds: Sequence[str] = ("one", "two", "near"), common: float = COMMON) -> Band:
    """The band with its cheapest index, for so many sets of shingles so common."""
    made = []
    for kind in kinds:
        if kind == "one":
            m = band.most + 1
            skip = 0
            for _ in range(4):
                m = band.most + 1 + 2 * skip
                empty = m * math.exp(-band.low / m)
                skip = math.ceil(2 * empty) if empty > 0.05 else 0
            m = band.most + 1 + 2 * skip
            tokens = band.low / m
        elif kind == "two":
            m, skip = band.most + 2, 0
            tokens = 2 * band.low / m
        else:
            m, skip = (band.most + 2) // 2, 0
            tokens = band.low / m - 1
        b = Band(band.low, band.high, band.most, kind, m, skip)
        made.append((b.signatures() * (1 + 4 * sets * common ** max(tokens, 0.5)), b))
    return min(made, key=lambda x: x[0])[1]


def signatures(s: np.ndarray, band: Band, number: int) -> np.ndarray:
    """The set's signatures in the index of a band."""
    seed = hashing.mix(np.array([number + 1], np.uint64))[0]
    segment = (((hashing.mix(s ^ seed) >> _U(40)) * _U(band.m)) >> _U(24)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], hashing.mix(s + seed)[order]
    starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    sums = np.zeros(band.m, np.uint64)
    sums[segment[starts]] = np.add.reduceat(value, starts)
    names = hashing.mix(np.arange(band.m, dtype=np.uint64) + seed)
    full = hashing.mix(sums + names)
    if band.kind == "near":
        return np.concatenate((full, hashing.mix(sums[segment] - value + names[segment])))
    if band.kind == "two":
        a, b = np.triu_indices(band.m, 1)
        return hashing.mix(full[a] + hashing.mix(full[b]))
    if band.skip:
        counts = np.bincount(segment, minlength=band.m)
        # by tokens, then by content; empty segments by place: sets with equal segments rank them alike
        rank = np.lexsort((np.where(counts == 0, np.arange(band.m, dtype=np.uint64), full), counts))
        return full[rank[band.skip :]]
    return full


def _sizes(width: int):
    """Sizes, ids and bounds of the rows' sets; ``bins`` holds the histogram and, behind it, the odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([histogram(s) + odd_sketch(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())],
                    names=["key", "text_id", "n", "sid", "bins", "fine"],
                )

    return run


def _index(width: int, plan: list[Band], parts: int):
    """Blocks of (40 bits of signature, set id), one for each slice and partition."""
    lows = np.array([b.low for b in plan])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", SLICE):
                seen, sigs, owners = set(), [], []
                for s in shingle_sets(batch.column("text").to_pylist(), width):
                    if not len(s) or (sid := set_id(s)) in seen:
                        continue
                    seen.add(sid)
                    at = int(np.searchsorted(lows, len(s), "right")) - 1
                    for k in (at, at + 1):
                        if k < len(plan) and plan[k].most:
                            got = signatures(s, plan[k], k)
                            sigs.append(got)
                            owners.append(np.full(len(got), sid, np.int64))
                if not sigs:
                    continue
                sig, owner = np.concatenate(sigs), np.concatenate(owners)
                part = (((sig >> _U(40)) * _U(parts)) >> _U(24)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, sig, owner = part[order], sig[order], owner[order]
                starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                ends = np.append(starts[1:], len(part))
                packed = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                data = [packed[a:b].tobytes() + owner[a:b].astype("<i8").tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(data, pa.binary())], names=["part", "block"])

    return run


BUCKETS = ["bucket", "piece", "k", "sids"]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of two or more sets that share a signature, each list once, long ones in pieces."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
            held.setdefault(part, []).append(block)
    for blocks in held.values():
        n = [len(b) // 13 for b in blocks]
        sig = np.zeros((sum(n), 8), np.uint8)
        sig[:, :5] = np.concatenate([np.frombuffer(b, np.uint8, 5 * k).reshape(-1, 5) for b, k in zip(blocks, n)])
        sig = sig.view("<u8").ravel()
        owner = np.concatenate([np.frombuffer(b, "<i8", k, 5 * k) for b, k in zip(blocks, n)])
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])))
        sig, owner = sig[keep], owner[keep]
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        ends = np.append(starts[1:], len(sig))
        many = ends - starts > 1
        done, lists = set(), []
        for a, b in zip(starts[many].tolist(), ends[many].tolist()):
            ids = owner[a:b]
            name = (b - a, set_id(ids.view(np.uint64)))
            if name not in done:
                done.add(name)
                lists.append((name[1], ids))
        rows = [(name, k // LIST, len(ids), ids[k : k + LIST]) for name, ids in lists for k in range(0, len(ids), LIST)]
        for lo in range(0, len(rows), 4096):
            some = rows[lo : lo + 4096]
            offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in some]))).astype(np.int32)
            made = [pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32()), pa.array([r[2] for r in some], pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[3] for r in some])))], names=BUCKETS)


def _apart(bins: np.ndarray, n: np.ndarray, one: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which sets can link with one, by the lower bound of the difference."""
    d = np.abs(bins - one).astype(np.int32)
    least = np.minimum(d, 256 - d).sum(axis=1)
    both = n + size
    return least * (100 + percent) <= (100 - percent) * both


def _folded(odd: np.ndarray) -> list[np.ndarray]:
    """Words of odd sketches: all folded to the shortest's length, then those longer to each next length; rows too short for one are 0 there."""
    rows = [np.frombuffer(x, np.uint64) for x in odd.tolist()]
    words = np.array([len(x) for x in rows])
    out = []
    for w in np.unique(words).tolist():
        level = np.zeros((len(rows), w), np.uint64)
        for i in np.flatnonzero(words >= w).tolist():
            level[i] = np.bitwise_xor.reduce(rows[i].reshape(-1, w), axis=0)
        out.append(level)
    return out


def _odd_apart(levels: list[np.ndarray], n: np.ndarray, words: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others can link with i, by the bits in which their odd sketches differ at each length that both have."""
    for level in levels:
        w = level.shape[1]
        if w > words[i]:
            break
        least = np.bitwise_count(level[others] ^ level[i]).sum(axis=1, dtype=np.int64)
        others = others[(words[others] < w) | (least * (100 + percent) <= (100 - percent) * (n[others] + n[i]))]
    return others


def _groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    """Consecutive rows of one bucket (the input is sorted by it)."""
    now, held = None, []
    for batch in batches:
        col = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        bucket = col[0]
        cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            if now is not None and bucket[a] != now:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held = []
            now = bucket[a]
            held.append([c[a:b] for c in col])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _matrix(bins: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(bins.tolist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _ties(percent: int):
    """Per cell of a bucket, pairs of a hub and the sets that may link with it; what no hub takes goes to the next. Of buckets in several cells also the hubs, as pairs of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bucket, cells, sid, n, bins in _groups(batches, ("cell", "bucket", "cells", "sid", "n", "bins")):
            bins, a, b = _matrix(bins), [], []
            for _ in range(8):
                if not len(sid) or len(sid) < 2 and cells[0] < 2:
                    break
                hub = int(np.abs(bins - bins.mean(axis=0)).sum(axis=1).argmin())
                near = _apart(bins, n, bins[hub], int(n[hub]), percent)
                near[hub] = cells[0] > 1
                a.append(np.full(int(near.sum()), sid[hub]))
                b.append(sid[near])
                rest = ~near
                rest[hub] = False
                sid, n, bins = sid[rest], n[rest], bins[rest]
            pairs = _pairs(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(pairs.num_rows, bucket[0])), *pairs.columns], names=["bucket", "a", "b"])

    return run


def _tied(members: DataFrame, info: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs to verify: sets with the hubs of their cell, hubs with the hubs of theirs, until a bucket is one cell."""
    found, now = None, members
    while True:
        now = now.join(info, "sid")
        cells = F.ceil(F.col("k") / BLOCK).cast("long")
        cell = F.when(cells > 1, F.xxhash64("bucket", F.pmod(F.xxhash64("sid", "bucket"), cells))).otherwise(F.col("bucket"))
        dealt = now.select(cell.alias("cell"), "bucket", cells.alias("cells"), "sid", "n", "bins").repartition(parts, "cell").sortWithinPartitions("cell", "sid")
        made = materialize(dealt.transform(arrow_map, _ties(percent), "bucket bigint, a bigint, b bigint"), "jaccard-ties")
        pairs = made.where("a <> b").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        hubs = made.where("a = b").select("bucket", F.col("a").alias("sid"))
        if not hubs.limit(1).count():
            return materialize(found.distinct(), "jaccard-ties")
        now = materialize(hubs.join(hubs.groupBy("bucket").agg(F.count("*").alias("k")), "bucket"), "jaccard-hubs")


def _across(percent: int):
    """Per block, pairs of sets in different components that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sid, n, odd, root, side in _groups(batches, ("block", "sid", "n", "odd", "root", "side")):
            levels, words, a, b = _folded(odd), np.array([len(x) // 8 for x in odd]), [], []
            for i in np.flatnonzero(side != 1).tolist():
                later = np.flatnonzero(root != root[i])
                later = later[side[later] == 1] if side[i] == 0 else later[later > i]
                if len(later):
                    near = _odd_apart(levels, n, words, i, later, percent)
                    a.append(np.full(len(near), sid[i]))
                    b.append(sid[near])
            yield _pairs(a, b)

    return run


#: Sets that one copy of a set they are to be compared with serves.
CELL = 256


def _requests(pairs: DataFrame) -> DataFrame:
    """Who is to meet where: (sid, pivot, cell, role), role 0 for the pivot itself.

    Of a pair the set with more pairs is the pivot, and the other comes to it;
    a pivot with many goes to a cell for each ``CELL`` of them, so a token set
    is sent once a pair for one side and once a cell for the other.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("sid").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("sid").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") >= F.col("db")
    met = both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("sid"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("pivot"), F.greatest("da", "db").alias("d"))
    met = met.withColumn("cell", F.pmod(F.xxhash64("sid", "pivot"), F.ceil(F.col("d") / CELL))).drop("d")
    pivots = met.select(F.col("pivot").alias("sid"), "pivot", "cell").distinct()
    return met.withColumn("role", F.lit(1)).unionByName(pivots.withColumn("role", F.lit(0)))


def _compared(column: str, links):
    """Per cell, the sets that link with its pivot by ``column``, a list or bytes; rows come sorted by cell and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine = None, None
        for batch in batches:
            sid, pivot, cell, role = (batch.column(c).to_numpy() for c in ("sid", "pivot", "cell", "role"))
            values = batch.column(column)
            if pa.types.is_binary(values.type):
                each = (np.frombuffer(x, np.uint8) for x in values.to_pylist())
            else:
                flat, at = values.flatten().to_numpy(), values.offsets.to_numpy() - values.offsets[0].as_py()
                each = (flat[a:b] for a, b in zip(at[:-1], at[1:]))
            found = []
            for i, own in enumerate(each):
                if role[i] == 0:
                    now, mine = (pivot[i], cell[i]), own.copy()
                elif (pivot[i], cell[i]) == now and links(mine, own):
                    found.append((min(sid[i], pivot[i]), max(sid[i], pivot[i])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _met(pairs: DataFrame, reps: DataFrame, column: str, values, links, name: str) -> DataFrame:
    """The pairs that link by ``column`` of ``values``, a function of a filter on keys; it is shuffled twice: to its requests, and to where it is compared."""
    asked = materialize(_requests(pairs), "jaccard-requests")
    need = materialize(asked.select("sid").distinct().join(reps, "sid").select(F.xxhash64("key").alias("h")), "jaccard-need")
    may = sieve(need, "h")
    parts = shuffle_partitions(pairs.sparkSession)
    met = values(may(F.xxhash64("key"))).dropDuplicates(["sid"]).join(asked, "sid")
    met = met.repartition(parts, "pivot", "cell").sortWithinPartitions("pivot", "cell", "role", "sid")
    return materialize(met.select("sid", "pivot", "cell", "role", column).transform(arrow_map, _compared(column, links), "a bigint, b bigint"), name)


def _verified(docs: DataFrame, table: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that link, by their exact sets; only those of pairs whose sketches are near are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["sid", "tokens"])

    def same(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    sketches = lambda asked: table.where(asked).select("sid", "fine")
    near = _met(pairs, reps, "fine", sketches, lambda a, b: near_sketches(a, b, percent), "jaccard-near")
    sets = lambda asked: docs.where(asked).select("text").transform(arrow_map, run, "sid bigint, tokens array<bigint>")
    return _met(near, reps, "tokens", sets, same, "jaccard-links")


def link(df: DataFrame, width: int = 3, percent: int = 90, kinds: Sequence[str] = ("one", "two", "near"), key: str = "doc_id", text: str = "text", degrees: bool = True, common: float = COMMON) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id (smallest key reachable), text_id, first_text_id and, with ``degrees``, n_links.

    Keys may repeat: ``text_id`` is a hash of the row's text, and key and
    ``text_id`` tell rows apart. The least such pair of a component, which is
    ``component_id`` and ``first_text_id``, is of one text of that component
    only; ``first_text_id`` is null where a row takes no part.

    ``n_links`` is how many other rows the row links with, its exact copies
    among them. Without it, pairs that others connect are not compared.
    """
    spark = df.sparkSession
    given = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = given.where("key is not null")
    named_texts = given.select("key", F.xxhash64("text").alias("text_id"), "text")
    table = materialize(named_texts.transform(arrow_map, _sizes(width), "key bigint, text_id bigint, n bigint, sid bigint, bins binary, fine binary"), "jaccard-sizes")
    sets = table.where("n > 0 and key is not null").groupBy("sid").agg(F.min(F.struct("key", "text_id")).alias("first"), F.min("n").alias("n"), F.first("bins").alias("bins"), F.count("*").alias("copies"))
    sets = sets.select("sid", "first.key", "first", "n", F.substring("bins", 1, BINS).alias("bins"), F.substring("bins", BINS + 1, BITS[1] // 8).alias("odd"), "copies")
    sets = materialize(sets, "jaccard-distinct")
    largest = sets.agg(F.max("n")).first()[0] or 0
    plan = bands(largest, percent)
    lows = F.array(*(F.lit(b.low) for b in plan)) if plan else F.array(F.lit(1))
    # one row for each band: as many as the logarithm of the largest size
    count = {r["band"]: r["count"] for r in sets.groupBy(F.size(F.filter(lows, lambda x: x <= F.col("n"))).alias("band")).count().collect()}
    held = [count.get(k + 1, 0) + count.get(k, 0) for k in range(len(plan))]
    plan = [allocate(b, n, kinds, common) for b, n in zip(plan, held)]
    total = sum(b.signatures() * n for b, n in zip(plan, held) if b.most)
    parts = int(max(shuffle_partitions(spark), total // FULL))
    blocks = docs.select("text").transform(arrow_map, _index(width, plan, parts), "part int, block binary").repartition(parts, "part")
    buckets = materialize(blocks.transform(arrow_map, _buckets, "bucket bigint, piece int, k bigint, sids array<bigint>"), "jaccard-buckets")
    info = sets.select("sid", "n", "bins")
    members = materialize(buckets.dropDuplicates(["bucket", "piece"]).select("bucket", "k", F.explode("sids").alias("sid")), "jaccard-members")
    ties = _tied(members, info, percent, parts)
    reps = sets.select("sid", "key")
    links = _verified(docs, table, reps, ties, width, percent)
    roots = components(links)
    # what hubs left apart: buckets of three or more sets, in more than one component; for degrees each set counts as its own
    named = members.where("k > 2").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.col("sid") if degrees else F.coalesce("root", "sid"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("home"), F.max("root").alias("y")).where("home <> y").select("bucket", "home")
    named = materialize(named.join(mixed, "bucket").select("home", "sid", "root").distinct(), "jaccard-mixed")
    cells = F.ceil(F.col("k") / BLOCK)
    mine = F.pmod(F.xxhash64("sid", "home"), cells)
    # each pair of cells of a home is a block of its own
    other = F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))
    cut = named.join(named.groupBy("home").agg(F.count("*").alias("k")), "home").withColumn("mine", mine).withColumn("other", other)
    cut = cut.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    side = F.when(F.col("lo") == F.col("hi"), 2).when(F.col("mine") == F.col("lo"), 0).otherwise(1)
    cut = cut.select(F.xxhash64("home", "lo", "hi").alias("block"), "sid", "root", side.cast("int").alias("side")).join(sets.select("sid", "n", "odd"), "sid")
    cut = cut.repartition(parts, "block").sortWithinPartitions("block", "sid").select("block", "sid", "n", "odd", "root", "side")
    more = cut.transform(arrow_map, _across(percent), "a bigint, b bigint").distinct().join(ties, ["a", "b"], "left_anti")
    more = materialize(more, "jaccard-across")
    if more.limit(1).count():
        links = links.unionByName(_verified(docs, table, reps, more, width, percent))
        roots = components(links)
    named = sets.select("sid", "first").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("sid", F.col("component.key").alias("component"), F.col("component.text_id").alias("first_text_id"))
    if degrees:
        copies = sets.select("sid", "copies")
        ends = links.select(F.col("a").alias("sid"), F.col("b").alias("other")).union(links.select("b", "a"))
        others = ends.join(copies.select(F.col("sid").alias("other"), "copies"), "other").groupBy("sid").agg(F.sum("copies").alias("others"))
        named = named.join(copies, "sid").join(others, "sid", "left").select("sid", "component", "first_text_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = materialize(named, "jaccard-components")
    out = table.select("key", "text_id", "n", F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.col("sid")).alias("sid")).join(named, "sid", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"), "text_id", "first_text_id", *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if degrees else []))
