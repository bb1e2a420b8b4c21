"""Merkle manifest, packing and whitening against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeweave.llm import merkle, packing, queries, whitening

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def save(spark, path, name, df):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# --- Merkle manifest


def plain_levels(nodes, fanout=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_path(levels, i, fanout=16):
    steps = []
    for level in levels[:-1]:
        lo = i // fanout * fanout
        steps.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + fanout])))
        i //= fanout
    return steps


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r: H(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: plain_levels([leaf(r) for r in groups[s]]) for s in names}
    over = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = plain_path(trees[s], i) + plain_path(over, k)
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf((*r[:4], r[4] and r[4].translate(lower)))
            for a, b in path:
                node = H(a, node, b)
            root = over[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, H(*(a + b for a, b in path)), node, node == root))
    return out


@pytest.mark.parametrize("sizes", [{"a": 700, None: 17, "é": 16, "b": 1, "c": 33}, {"a": 1}, {"x": 20}, {f"s{i}": 1 for i in range(40)}])
def test_merkle_query_equals_a_plain_tree(spark, tmp_path, sizes):
    rng, rows = random.Random(1), []
    for source, n in sizes.items():
        for _ in range(n):
            d = rng.choice([None, *range(2000)])
            rows.append((d, source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Äb C", "", None, "lower only", "Text " * 50])))
    rows += rows[:5]  # repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "tree": F.lit("x"), "leaf": F.lit(2), "a.b": F.lit(0)})
    got = queries.QUERIES["op11_merkle_manifest"](spark, save(spark, tmp_path, "documents", docs)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))


def test_merkle_of_nothing_and_of_long_texts(spark, tmp_path):
    assert queries.QUERIES["op11_merkle_manifest"](spark, save(spark, tmp_path / "none", "documents", spark.createDataFrame([], SCHEMA))).collect() == []
    rows = [(1, "a", "en", 1, "Ab " * 700_000), (2, "a", "en", 1, "")]
    got = queries.QUERIES["op11_merkle_manifest"](spark, save(spark, tmp_path / "long", "documents", spark.createDataFrame(rows, SCHEMA))).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))


def test_merkle_finds_a_changed_leaf(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "en", 1, f"text {i}") for i in range(100)], SCHEMA)
    tree = merkle.build(docs, ("doc_id", "text"), carry={"forged": F.sha2(F.lit("other"), 256)}, fanout=4)
    found = merkle.proofs(tree).select(merkle.fold(F.col("leaf"), F.col("path")).alias("own"), merkle.fold(F.col("forged"), F.col("path")).alias("forged")).collect()
    assert len(found) == 100 and all(r.own == tree.root and r.forged != tree.root for r in found)


def test_merkle_order_spreads_one_group_of_equal_keys(spark):
    docs = spark.createDataFrame([(7, "a", "en", 1, "same")] * 4000, SCHEMA)
    tree = merkle.build(docs, ("doc_id", "text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = merkle._placed(docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key")), ["group", "key"], "t").groupBy("__part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in rows) < 2500 and sum(r["count"] for r in rows) == 4000
    assert tree.leaves.agg(F.countDistinct("idx"), F.max("idx")).first()[:] == (4000, 3999)


# --- packing


def check_plan(counts, cap, **how):
    runs, sequences = packing.plan(counts, cap, **how)
    fill, ends = {}, []
    by = {}
    for r in sorted(runs):
        by.setdefault(r.length, []).append(r)
    for length, count in counts.items():
        mine = by.get(length, [])
        assert not count or mine[0].first == 0
        for r, after in zip(mine, [m.first for m in mine[1:]] + [count]):
            for k in range(after - r.first):
                fill.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * length, length))
    for places in fill.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= cap
        ends.append(end)
    assert len(fill) == sequences or not counts
    return sequences, -(-sum(k * v for k, v in counts.items()) // cap)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_gapless_and_within_the_cap(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 64, 256])
    counts = {n: rng.choice([0, 1, 3, 40]) for n in rng.sample(range(1, cap + 1), rng.randint(1, cap))}
    check_plan(counts, cap, settings=[(rng.choice([1, 3, 16]), rng.choice([1 / 8, 1 / 3]))])


def test_plan_is_tight():
    rng = random.Random(3)
    counts = Counter(min(256, max(1, int(rng.lognormvariate(4.2, 0.8)))) for _ in range(20_000))
    used, least = check_plan(counts, 256)
    assert used <= 1.005 * least
    assert check_plan({3: 5}, 6)[0] == 3 and check_plan({5: 2, 1: 2}, 6)[0] == 2
    assert check_plan({4: 300, 3: 300}, 7)[0] == 300  # a configuration that longest-first alone also finds
    assert check_plan({50: 600, 30: 600, 20: 600}, 100)[0] <= 606  # longest first alone takes 620


def test_configurations_cover_the_demand():
    sizes, demand = [62, 41, 40, 35], [10, 31, 7, 50]
    made = packing.configurations(sizes, demand, 100)
    assert all(np.dot(p, sizes) <= 100 for p, _ in made)
    assert np.all(sum(p * n for p, n in made) >= np.array(demand) - 1e-6)
    assert sum(n for _, n in made) <= 49 + 1e-6


def test_packing_query_and_its_sequences(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [None, "", "a", "word " * 9000, "x" * 5000] + [" ".join(rng.choices(["alpha", "beta", "Ünï", "42", "\n"], k=rng.choice([3, 80, 900, 2500]))) for _ in range(300)]
    rows = [(rng.choice([None, 4, i]), "s", "en", 0, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit(1), "key": F.lit("k"), "length": F.lit(9), "a.b": F.lit(0)})
    made = packing.pack(docs.repartition(7), P.path("byte_bpe_50k.json"))
    whole = packing.sequences(made).collect()
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for d, *_, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        n = len(ids)
        cuts = [0, *range(n % 2048 or 2048, n + 1, 2048)] if n > 2048 else [0, n]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, j, a, b - a, tuple(ids[a:b])] += 1
    got = Counter()
    for s in whole:
        ids, end = np.frombuffer(s.ids, "<u4"), 0
        for p in s.parts:
            assert p.offset == end
            end += p.length
            got[p.key, p.piece, p.start, p.length, tuple(ids[p.offset : end].tolist())] += 1
        assert end == s.n_tokens == len(ids) <= 2048
    assert got == want
    rooms = []  # longest first, each to the fullest with room
    for length in sorted((k[3] for k, n in want.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 2048) - length)
    assert len(whole) <= 1.02 * len(rooms) + 1
    asked = queries.QUERIES["op12_best_fit_packing"](spark, save(spark, tmp_path, "documents", docs)).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in asked) == Counter(x for k, n in want.items() for x in [(*k[:4], crc(k[4]))] * n)
    assert packing.pack(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).collect() == []


def test_packing_numbers_one_hot_length_over_all_tasks(spark):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(i, "s", "en", 0, "same") for i in range(3000)], SCHEMA).repartition(6)
    cut = packing.pieces(docs, P.path("byte_bpe_50k.json"))
    assert cut.select("task").distinct().count() == 6
    made = packing.placed(cut)
    n = cut.first()["length"]
    assert made.select("sequence_id", "offset").distinct().count() == 3000
    assert made.select("sequence_id").distinct().count() == -(-3000 // (2048 // n))


# --- whitening


def plain_whitening(vectors, components):
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    exact = [[n * a - s for a, s in zip(row, sums)] for row in x]
    c = np.array([[a / n for a in row] for row in exact])
    v = c.T @ c / n
    values, vecs = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return [sum(a * a for a in row) for row in exact], c @ vecs[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def test_whitening_query_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 7).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(900, None), (901, [None] + [1.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0] * 7)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumns({"key": F.lit("k"), "x": F.lit(1), "whitened": F.lit(0), "a.b": F.lit(1)})
    got = queries.QUERIES["op13_embedding_whitening"](spark, save(spark, tmp_path, "embeddings", df)).collect()
    deviation, white, explained = plain_whitening(data, 32)
    assert len(got) == 300 * 32
    mine = np.zeros((300, 32))
    for r in got:
        assert r.n == 300 and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        mine[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7


def test_whitening_of_few_equal_and_large_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whitening.whiten(frame([])).collect() == []
    one = whitening.whiten(frame([(None, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r.whitened == 0 and r.explained is None and r.deviation == 0 and r.n == 2 for r in one)
    large = whitening.whiten(frame([(1, [1e10, 0.0]), (2, [-1e10, 5.0]), (3, [3e9, 1.0]), (4, [1e300, 0.0])]), 1).collect()
    assert sorted(r.key for r in large) == [1, 2, 3] and all(r.deviation is None for r in large)  # beyond a long
    assert sum(r.whitened**2 for r in large) / 3 == pytest.approx(1, rel=1e-9)
    key = 2**60 + 1
    kept = whitening.whiten(frame([(key, [1.0, 3.0]), (None, [2.0, 1.0]), (5, [0.5, 0.25])])).collect()
    assert {r.key for r in kept} == {key, None, 5}


def test_entries_that_no_long_holds_are_no_overflow(spark):
    rows = [(1, [0.5, -2.0]), (2, [float("inf"), 0.0]), (3, [float("nan"), 0.0]), (4, [1e300, -1e300]), (5, [None, 1.0]), (6, [2.0**56, 0.0]), (7, [1.0]), (8, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    kept = whitening.one_length(whitening.integer_rows(df)).collect()
    assert {r.key: r.x for r in kept} == {1: [1_000_032, 999_872], 6: [2**62 + 1_000_000, 1_000_000]}


# --- the sieve before joins of texts


def test_sieve_never_loses_a_key(spark):
    from gradeweave.llm.sieve import sieve

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    for most, least in ((1 << 26, 0.95), (1 << 10, 0.0)):
        passed = {r.id for r in rows.where(sieve(keys, "h", most)(F.col("h"))).select("id").collect()}
        assert passed >= set(range(3000)) and 20_000 - len(passed) >= least * 17_000
    none = sieve(keys.limit(0), "h")
    assert rows.withColumn("h", F.when(F.col("id") > 5, F.col("h"))).where(none(F.col("h"))).count() == 0


def test_mix_with_clashing_names_and_no_weight(spark):
    from gradeweave.llm import mixing

    rows = [(i, f"s{i % 3}", "en", 1, "w " * (i % 7) if i % 3 else "") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"__planned": F.lit(1), "__row": F.lit(2), "__position": F.lit(3), "a.b": F.lit(4)})
    plan = mixing.schedule(docs, weights=(1.0, 0.0, 2.0))
    targets = {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    assert targets["s0"] == targets["s1"] == 0 and targets["s2"] > 0
    out = mixing.mix(docs, plan)
    assert out.columns == docs.columns and {r.source for r in out.collect()} == {"s2"}
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.schedule(docs, weights=(0.0,)).agg(F.sum("copies")).first()[0] == 0


# --- names with dots, adverse and very long texts, large components


def test_columns_with_dots_pass_through(spark):
    P = pytest.importorskip("public_tokenizers")
    from gradeweave.llm import bpe, secrets

    docs = spark.createDataFrame([(1, "a token = abcdefghijklmnop", 5, "x")], "doc_id bigint, text string, `a.b` int, `c``d` string")
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    r = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks).first()
    assert r["a.b"] == 5 and r["c`d"] == "x" and bytes(r.decoded).decode() == r.text
    assert secrets.scan(docs).first()["a.b"] == 5


def test_web_tokens_are_found_in_one_pass():
    import time

    from gradeweave.llm import secrets

    find = secrets.finder(next(r for r in secrets.MORE if r.kind == "web_token"))
    token = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 8
    assert [t[a:b] for t in [f"x {token}, '{token}'"] for a, b in find(t)] == [token, token]
    t = time.time()
    assert find("eyJ" * 400_000) == [] and find("eyJ" + "a" * 20 + "." + "eyJ" * 300_000) == []
    assert time.time() - t < 2


def test_top_k_leaves_out_what_scores_cannot_hold(spark):
    from gradeweave.llm import topk

    rows = [(0, [1e10, 0.0]), (50, [1e300, 1.0]), (100, [1.0, 2.0]), (3, [2.0, 1.0]), (4, [-1e10, 1e10]), (5, [5e6, -5e6])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.key, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    at = lambda v: [int(np.floor(256 * x)) for x in v]
    score = lambda a, b: sum(x * y for x, y in zip(at(a), at(b)))
    assert sorted(got) == [(100, 1, 3, score([1, 2], [2, 1])), (100, 2, 5, score([1, 2], [5e6, -5e6]))]


def test_very_long_texts(spark):
    from gradeweave.llm import jaccard, mixing, ngrams, quality, repeats

    long = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, "s"), (2, long + " end", "s"), (3, "short text", "s"), (4, None, "s")], "doc_id bigint, text string, source string")
    assert {r.doc_id: r.component_id for r in jaccard.link(docs, 5, 80).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    cut = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert cut[2].n_removed == 300_000 and cut[1].n_removed == 0
    assert {r.doc_id: r.n_words for r in quality.with_statistics(docs).collect()}[1] == 300_000
    assert {r.key: r["size"] for r in mixing.schedule(docs).collect()} == {1: 300_000, 2: 300_001, 3: 2, 4: 0}
    held = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    scored = {r.doc_id: r for r in ngrams.score(held, ngrams.fit(held, order=3)).collect()}
    assert scored[1].n_tokens == 300_001 and scored[1].score < 0
