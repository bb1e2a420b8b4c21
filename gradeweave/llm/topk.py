"""Exact top-k by inner product over KD-trees, one per shard.

Rows are numbered and dealt to shards by a hash of the number, so repeated
keys spread; each shard becomes a tree (median splits of the widest component,
tight boxes) in a file in the shared folder. The stated queries become files of
``block`` queries. A task takes one block through a few trees in turn: best
first by the bound between box and query, and on from tree to tree with the
k-th best found so far; bounds from a first tree are in every task's hands from
the start, and each tree's outer box is in the manifest, so a file that can't
better any query of the block isn't opened. What leaves a task is at most k
rows a query.

Scores are integers and exact (floating point only where every sum fits).
Ties go to the smaller key; boxes carry their smallest key, so equal vectors
in any number are cut off too.

Defined results: vectors that are null, or hold a null or a non-finite
component, or one so large that a score could leave 64 bits (2^23 over the
root of the dimension), and null keys take no part; keys are longs, others are
cast and an error where they can't be; a key's repeated rows are rows like
others: each is a candidate, also for the others of its key, and each is a
query if its key is one; vectors are compared with those of the same length;
with no candidates a query has no rows.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.llm.common import arrow_map, attempt_name, materialize, new_dir, read_buffer, write_bytes

LEAF = 128


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double; null for vectors that take no part."""
    most = F.lit(2.0**23) / F.sqrt(F.size(embedding).cast("double"))  # sums of products then stay within 62 bits
    ok = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < most, F.lit(False)))  # false for NaN, too
    return F.when(embedding.isNotNull() & ok, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


def build(rows: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A tree: rows in leaf order; per node its range of rows, children (-1: leaf), box and smallest key."""
    order = np.argsort(keys, kind="stable")
    nodes: list[tuple[int, int, int, int]] = []

    def split(lo: int, hi: int) -> int:
        me = len(nodes)
        nodes.append((lo, hi, -1, -1))
        if hi - lo > LEAF:
            part = vectors[order[lo:hi]]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order[lo:hi] = order[lo:hi][np.argsort(part[:, widest], kind="stable")]
            mid = (lo + hi) // 2
            nodes[me] = (lo, hi, split(lo, mid), split(mid, hi))
        return me

    split(0, len(keys))
    lo, hi, left, right = np.array(nodes, np.int64).T
    rows, keys, vectors = rows[order], keys[order], vectors[order]
    low = np.array([vectors[a:b].min(axis=0) for a, b in zip(lo, hi)])
    high = np.array([vectors[a:b].max(axis=0) for a, b in zip(lo, hi)])
    least = np.array([keys[a:b].min() for a, b in zip(lo, hi)])
    return {"rows": rows, "keys": keys, "vectors": vectors, "lo": lo, "hi": hi, "left": left, "right": right, "low": low, "high": high, "least": least}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(uri: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(read_buffer(uri))) as f:
        return {k: f[k] for k in f.files}


def _kind(vectors: np.ndarray, queries: np.ndarray):
    """The number type in which every inner product is exact."""
    biggest = max(int(np.abs(vectors).max(initial=0)), 1) * max(int(np.abs(queries).max(initial=0)), 1) * queries.shape[1]
    return np.float64 if biggest < 1 << 53 else np.int64 if biggest < 1 << 63 else object


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest inner product that each query can have in each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def search(tree: dict[str, np.ndarray], query_rows: np.ndarray, queries: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> None:
    """Update each query's ``best``: at most k pairs (score, -key), a heap with the worst on top."""
    kind = _kind(tree["vectors"], queries)
    q = queries.astype(kind)
    vectors, low, high = (tree[n].astype(kind) for n in ("vectors", "low", "high"))
    bounds = _bounds(q, low, high)
    least, left, right, lo, hi = (tree[n].tolist() for n in ("least", "left", "right", "lo", "hi"))
    keys, rows = tree["keys"], tree["rows"]
    for i, own in enumerate(query_rows.tolist()):
        bound, heap = bounds[i].tolist(), best[i]
        todo = [(-bound[0], least[0], 0)]
        while todo:
            up, small, node = heapq.heappop(todo)
            if len(heap) == k and (-up, -small) <= heap[0]:  # nothing inside is better
                if -up < heap[0][0]:
                    break
                continue
            if left[node] >= 0:
                for child in (left[node], right[node]):
                    heapq.heappush(todo, (-bound[child], least[child], child))
                continue
            score = vectors[lo[node] : hi[node]] @ q[i]
            inside = np.flatnonzero(score >= heap[0][0]) if len(heap) == k else range(len(score))
            for j in inside:
                pair = (int(score[j]), -int(keys[lo[node] + j]))
                if rows[lo[node] + j] == own:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, pair)
                elif pair > heap[0]:
                    heapq.heapreplace(heap, pair)


FILES = "dim int, group bigint, path string, n bigint, low array<bigint>, high array<bigint>"


def _files(rows: DataFrame, out_dir: str, trees: bool) -> DataFrame:
    """Write each (dim, group) of rows sorted by them as a file; return (dim, group, path, n, low, high): the file and its box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            r, k, v = (np.concatenate(x) for x in zip(*held))
            path = f"{out_dir}/{'tree' if trees else 'block'}-{now[0]}-{now[1]}-{attempt_name()}.npz"
            write_bytes(path, pack(build(r, k, v) if trees else {"rows": r, "keys": k, "vectors": v}))
            made = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([path]), pa.array([len(k)], pa.int64())]
            made += [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (v.min(axis=0), v.max(axis=0))]
            return pa.RecordBatch.from_arrays(made, names=["dim", "group", "path", "n", "low", "high"])

        for batch in batches:
            dim, group, row, key = (batch.column(c).to_numpy() for c in ("dim", "group", "row", "key"))
            values = batch.column("v")
            flat, offsets = values.flatten().to_numpy(), values.offsets.to_numpy() - values.offsets[0].as_py()
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (group[1:] != group[:-1])) + 1
            for a, b in zip(np.concatenate(([0], cuts)), np.append(cuts, len(dim))):
                if a == b:
                    continue
                if now is not None and now != (int(dim[a]), int(group[a])):
                    yield flush()
                    held = []
                now = (int(dim[a]), int(group[a]))
                held.append((row[a:b], key[a:b], flat[offsets[a] : offsets[b]].reshape(b - a, now[0])))
        if held:
            yield flush()

    return rows.transform(arrow_map, run, FILES)


def _run(tasks: DataFrame, k: int) -> DataFrame:
    """tasks: block path, trees (path and box), and for each query of the block what is known (row, score, key of its k-th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, trees, known in zip(*(batch.column(c).to_pylist() for c in ("block_path", "trees", "known"))):
                q = unpack(block)
                worst = {x["row"]: (x["score"], -x["key"]) for x in known or []}
                # a known k-th holds k places; what is beaten by it never shows
                best = [[worst[i]] * k if i in worst else [] for i in q["rows"].tolist()]
                for tree in trees:
                    box = np.array([tree["low"], tree["high"]], np.int64)
                    kind = _kind(box, q["vectors"])
                    top = _bounds(q["vectors"].astype(kind), *box.astype(kind)[:, None])[:, 0].tolist()
                    if any(len(heap) < k or up >= heap[0][0] for up, heap in zip(top, best)):
                        search(unpack(tree["path"]), q["rows"], q["vectors"], best, k)
                rows = [(i, own, s, -m) for i, own, heap in zip(q["rows"].tolist(), q["keys"].tolist(), best) for s, m in heap if worst.get(i) != (s, m)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in (0, 1, 3, 2)], names=["row", "query_id", "key", "score"])

    return tasks.transform(arrow_map, run, "row bigint, query_id bigint, key bigint, score bigint")


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, block: int = 256, trees_a_task: int = 4) -> DataFrame:
    """(query_id, rank, key, score): each query row's k best other rows."""
    spark = df.sparkSession
    given = df.select(F.col(key).cast("long").alias("key"), quantised(F.col(vector)).alias("v"), is_query.alias("q")).where("key is not null and v is not null and size(v) > 0")
    # numbers hold once they are written
    rows = materialize(given.select(F.monotonically_increasing_id().alias("row"), "key", "v", "q", F.size("v").alias("dim")), "topk-vectors")
    n, n_queries = rows.count(), rows.where("q").count()
    shards, blocks = -(-n // shard_rows) or 1, -(-n_queries // block) or 1
    out_dir = new_dir(spark, "topk-files")
    grouped = lambda d, m: d.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(m))).select("dim", "group", "row", "key", "v").repartition(m, "dim", "group").sortWithinPartitions("dim", "group")
    trees = materialize(_files(grouped(rows, shards), out_dir, True), "topk-trees")
    asked = materialize(_files(grouped(rows.where("q"), blocks), out_dir, False), "topk-blocks")
    tree = F.struct("path", "low", "high")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("group")
    b = asked.select("dim", "group", F.col("path").alias("block_path"))
    deal = lambda d: d.repartition(max(1, min(20_000, blocks * -(-shards // trees_a_task))))
    # a first tree for each block
    first = trees.groupBy("dim").agg(F.min_by(tree, "group").alias("__tree"))
    opening = b.join(first, "dim").select("block_path", F.array("__tree").alias("trees"), F.lit(None).cast("array<struct<row:bigint,score:bigint,key:bigint>>").alias("known"))
    opened = materialize(_run(deal(opening), k), "topk-first")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "key"))
    kth = opened.withColumn("r", place).where(F.col("r") == k).select("row", "score", "key").join(rows.select("row", "dim"), "row")
    known = kth.groupBy("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("group")).agg(F.collect_list(F.struct("row", "score", "key")).alias("known"))
    others = trees.join(first.select("dim", F.col("__tree.path").alias("path")), ["dim", "path"], "left_anti")
    packs = others.groupBy("dim", F.floor(F.col("group") / trees_a_task).alias("pack")).agg(F.collect_list(tree).alias("trees"))
    rest = packs.select("dim", "trees", each).join(b, ["dim", "group"]).join(known, ["dim", "group"], "left").select("block_path", "trees", "known")
    found = opened.unionByName(_run(deal(rest), k))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("key"), "score")
