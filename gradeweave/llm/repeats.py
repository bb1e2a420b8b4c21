"""Substring dedup by shared anchors and exact window keys.

1. Seeds: winnowing picks anchors (runs of ``gram`` words with the smallest
   hash in a row), so that any two places that share ``window`` words share an
   anchor. Anchors are joined across documents; those in one document only
   leave.
2. Windows, in place of extension: a window's smallest run is an anchor, in
   every document that has the window. So the windows whose smallest run is a
   shared anchor are hashed and compared with the equal windows of other
   documents; all others have no equal. No match is extended word by word and no maximal
   repeat is formed or returned; the words removed are those that extending
   matches of ``window`` words or more would cover. Comparing windows by key
   instead of document pairs keeps the work linear: a passage in k documents
   costs k rows, not k*k pairs. A slice of documents settles its own repeats
   first and sends one row per window, so a passage in a third of all documents
   costs at most a row a slice in any task.
3. Words covered by a window that also starts in a document with a smaller key
   go.

Text is shuffled once, for the documents with shared anchors are only known
after the anchors are joined; the others' results come from the first scan.

Defined results: a null text has no words; texts shorter than ``window`` words
stay whole; a null key takes no part and stays whole; rows with equal keys are
never repeats of each other; a text longer than a slice is a slice of its own,
whole; keys are longs, others are cast and an error where they can't be; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm import hashing
from gradeweave.llm.common import arrow_map, materialize, rows_by_bytes

GRAM = 8
SLICE = 4 << 20


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, hash) of the winnowed anchors of texts joined end to end."""
    n = len(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][text] - np.arange(n)  # words to the text's end
    reach = window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = hashing.runs(hashes, gram)
    low = hashing.sliding(g, reach, np.minimum)
    low = np.where(left[: len(low)] >= window, low, np.uint64(0))
    pad = np.zeros(reach - 1, np.uint64)
    top = hashing.sliding(np.concatenate((pad, low, pad)), reach, np.maximum)[: len(g)]
    at = np.flatnonzero((top == g) & (left[: len(g)] >= gram) & (g != 0))
    return at, text[at], g[at]


def _scan(window: int, gram: int):
    """Per text: number of words, sum of the words, distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", SLICE):
                texts = batch.column("text").to_pylist()
                hashes, first, data, start, end = hashing.words(texts)
                _, text, g = anchors(hashes, first, window, gram)
                order = np.lexsort((g, text))
                text, g = text[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (text[1:] != text[:-1]) | (g[1:] != g[:-1])
                text, g = text[new], g[new]
                offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                sums = [hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("uid"), pa.array(np.diff(first), pa.int64()), pa.array(sums), pa.ListArray.from_arrays(pa.array(offsets), pa.array(g.view(np.int64)))],
                    names=["key", "uid", "n_words", "sha", "anchors"],
                )

    return run


def _windows(window: int, gram: int):
    """Windows whose smallest run is a shared anchor: rows to compare, and repeats that the slice itself settles (``done``)."""
    reach = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", SLICE):
                keys, uids = (batch.column(c).to_numpy() for c in ("key", "uid"))
                hashes, first, *_ = hashing.words(batch.column("text").to_pylist())
                seeds = batch.column("seeds")
                owner = np.repeat(np.arange(len(seeds)), np.diff(seeds.offsets.to_numpy()))
                wanted = seeds.flatten().to_numpy().view(np.uint64)
                if len(hashes) < window or not len(wanted):
                    continue
                low = hashing.sliding(hashing.runs(hashes, gram), reach, np.minimum)  # of each window
                wanted = hashing.mix(wanted + np.uint64(1)) ^ owner.astype(np.uint64)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                starts = np.flatnonzero(first[1:][owner[: len(low)]] - np.arange(len(low)) >= window)
                where = starts[np.isin(hashing.mix(low[starts] + np.uint64(1)) ^ owner[starts].astype(np.uint64), wanted)]
                if not len(where):
                    continue
                h = hashing.runs(hashes, window)[where]
                key, own = keys[owner[where]], owner[where]
                order = np.lexsort((where, own, key, h))
                h, key, own, where = h[order], key[order], own[order], where[order]
                start = where - first[own]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                group = np.cumsum(new) - 1
                least = key[new][group]
                # settled here: a smaller key of the slice has the window
                yield from _rows(None, key, uids[own], start, own, key > least)
                yield from _rows(h, key, uids[own], start, own, key == least)

    return run


def _rows(h, key, uid, start, own, keep) -> Iterator[pa.RecordBatch]:
    """Rows of one window or, without ``h``, of one text, whose hash then takes its place: starts as little-endian uint32."""
    key, uid, start, own = key[keep], uid[keep], start[keep], own[keep]
    if not len(key):
        return
    if h is None:
        order = np.lexsort((start, own))
        key, uid, start, own = key[order], uid[order], start[order], own[order]
        new = np.concatenate(([True], own[1:] != own[:-1]))
    else:
        h = h[keep]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])))
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(key))
    data = start.astype("<u4")
    alone = (ends - at == 1) & (h is not None)
    more = pa.array([None if one else data[a:b].tobytes() for one, a, b in zip(alone.tolist(), at.tolist(), ends.tolist())], pa.binary())
    hs = uid[at] if h is None else h[at].view(np.int64)
    made = [pa.array(hs, pa.int64()), pa.array(key[at], pa.int64()), pa.array(uid[at], pa.int64()), pa.array(start[at], pa.int32()), more, pa.array(np.full(len(at), h is None))]
    yield pa.RecordBatch.from_arrays(made, names=["h", "key", "uid", "start", "more", "done"])


def _drop(window: int):
    """Remove the words that the windows at the given starts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_by_bytes(whole, "text", SLICE):
                out = []
                for text, singles, packed in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "more"))):
                    words = text.encode("utf-8", "surrogatepass").split()
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.concatenate([np.array(singles or [], np.uint32), *(np.frombuffer(p, "<u4") for p in packed or [])])).astype(np.int64)
                    change[at] += 1
                    np.add.at(change, at + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    out.append((int(gone.sum()), kept))
                made = [pa.array([n for n, _ in out], pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for _, k in out], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("uid"), *made], names=["key", "uid", "n_removed", "kept"])

    return run


def remove_repeats(df: DataFrame, window: int = 50, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256, kept.

    ``kept`` is the text that stays, words joined by one space, of documents
    that lost words; null: nothing was removed.
    """
    docs = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("uid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scanned = materialize(docs.transform(arrow_map, _scan(window, gram), "key bigint, uid bigint, n_words bigint, sha string, anchors array<bigint>"), "repeat-anchors")
    seeds = scanned.where("key is not null").select("key", "uid", F.explode("anchors").alias("anchor"))
    shared = materialize(seeds.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("anchor"), "repeat-shared")
    wanted = materialize(seeds.join(shared, "anchor", "left_semi").groupBy("key", "uid").agg(F.collect_set("anchor").alias("seeds")), "repeat-seeds")
    reach = materialize(docs.where("key is not null").join(wanted, ["key", "uid"]).select("key", "uid", "text", "seeds"), "repeat-texts")
    # windows are made twice, which is cheaper than to keep them: a row a window is several times the text
    rows = reach.transform(arrow_map, _windows(window, gram), "h bigint, key bigint, uid bigint, start int, more binary, done boolean")
    # the smallest key of a window is found before rows meet; a window in many slices is a join's skew, which Spark splits
    least = rows.where("not done").groupBy("h").agg(F.min("key").alias("least"))
    found = rows.join(least, "h", "left").where("done or key > least").select("key", "uid", "start", "more")
    starts = found.groupBy("key", "uid").agg(F.collect_list(F.when(F.col("more").isNull(), F.col("start"))).alias("starts"), F.collect_list("more").alias("more"))
    cut = reach.select("key", "uid", "text").dropDuplicates(["key", "uid"]).join(starts, ["key", "uid"]).transform(arrow_map, _drop(window), "key bigint, uid bigint, n_removed bigint, kept string")
    out = scanned.select("key", "uid", "n_words", "sha").join(cut, ["key", "uid"], "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.sha2("kept", 256), F.col("sha")).alias("kept_sha256"), "kept")
