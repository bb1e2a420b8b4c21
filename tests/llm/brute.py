"""Plain versions of the queries, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def secrets(text, more=()):
    t = text or ""
    base = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 12:
            base.append((m.start(), 0, "assign", m.end()))
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    every = base + [(a, 3 + k, r.kind, b) for k, r in enumerate(more) for a, b in ((m.start(), m.end()) for m in re.finditer(r.pattern, t)) if True]
    show = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s))
    n = Counter(k for _, _, k, _ in base)
    return n["assign"], n["access"], n["hex"], sha(show(base)), show(every)


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def mix_targets(sizes, weights=(5, 2, 1), most=3.0):
    """source -> target, by rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = lower(host)
    best = None
    for v, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard(rows, width=3, percent=90):
    """(doc_id, text) rows to {doc_id: (n_shingles, component_id)}."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter()
    for ids in where.values():
        for a in range(len(ids)):
            for b in ids[a + 1 :]:
                shared[ids[a], b] += 1
    links = [(a, b) for (a, b), o in shared.items() if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o)]
    comp = components(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[comp[i]][0]) for i in range(len(rows))}


def repeats(rows, width=50):
    """(doc_id, text) rows to {doc_id: (n_words, n_removed, kept_sha256)}."""
    rows = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, w in rows:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def topk(rows, every=50, k=5):
    """(vec_id, vector) rows to (query, rank, vec_id, score) rows."""
    ok = [(i, [math.floor(256.0 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, own) in enumerate(ok):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v)), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(own))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def base_scores(rows):
    """(doc_id, text) rows to {doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    words = {d: WORD.findall(lower(t or "")) + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    c = Counter(x for d, w in words.items() if not held[d] for x in w)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in words.items()}


def ngram_scores(rows, order=3):
    """(doc_id, text) rows to {doc_id: log10 probability}: interpolated absolute discounting, one discount an order."""
    words = {d: [*WORD.findall(lower(t or "")), None] for d, t in rows}
    train = [w for d, w in words.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    one = Counter(x for w in train for x in w)
    n, v = sum(one.values()), len(one)
    grams = {k: Counter((tuple(["<s>", *w][i - k + 2 : i + 1]), w[i]) for w in train for i in range(k - 2, len(w))) for k in range(2, order + 1)}
    total, kinds, discount = {}, {}, {}
    for k, g in grams.items():
        total[k], kinds[k] = Counter(), Counter()
        for (context, _), c in g.items():
            total[k][context] += c
            kinds[k][context] += 1
        once, twice = (sum(c == times for c in g.values()) for times in (1, 2))
        discount[k] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    out = {}
    for d, w in words.items():
        s = 0.0
        for i, x in enumerate(w):
            p = (one[x] + 1) / (n + v + 1)
            for k in range(2, order + 1):
                context = tuple(["<s>", *w][max(0, i - k + 2) : i + 1])
                if i >= k - 2 and total[k][context]:
                    c = grams[k][context, x]
                    p = max(c - discount[k], 0) / total[k][context] + discount[k] * kinds[k][context] / total[k][context] * p
            s += math.log10(p)
        out[d] = s
    return out
