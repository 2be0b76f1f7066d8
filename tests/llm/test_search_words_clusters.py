"""Nearest neighbours, spelling variants and centroids against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from hemicycle.llm import centroids, nn_descent, spelling

VECTORS = "vec_id long, embedding array<double>, cluster string, node long, rank string"


def vector_rows(rows):
    return [(i, v, "clash", 7, "x") for i, v in rows]


def brute_nearest(rows, top, every):
    """Ten nearest by exact distances; the smallest vector of an id counts."""
    one = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            one[i] = min(one.get(i, v), v)
    out = {}
    for q, v in one.items():
        if q % every == 0:
            near = sorted((math.dist(v, w), i) for i, w in one.items() if i != q and len(w) == len(v))
            out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(near[:top])]
    return out


def found_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_neighbours_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, base[3].tolist()) for i in range(40)]  # more copies than an answer has places
    rows += [(200 + i, rng.normal(size=3).tolist()) for i in range(4)]  # fewer candidates than places
    rows += [(7, base[7].tolist()), (7, base[8].tolist()), (None, base[0].tolist()), (300, None), (301, [0.0] * 6), (302, []), (303, [math.nan] + [1.0] * 5)]
    rows += [(304, [None] + [1.0] * 5), (305, [math.inf] * 6), (310, [1e300] * 6), (311, [-0.0, 1.0]), (312, [0.0, 1.0])]
    df = spark.createDataFrame(vector_rows(rows), VECTORS).repartition(5)
    got, want = found_nearest(nn_descent.nearest_vectors(df, every=5)), brute_nearest(rows, 10, 5)
    want = {q: w for q, w in want.items() if w}
    assert {q: [x[:2] for x in w] for q, w in got.items()} == {q: [x[:2] for x in w] for q, w in want.items()}
    assert all(a[2] == pytest.approx(b[2], rel=1e-12) for q in got for a, b in zip(got[q], want[q], strict=True))
    assert nn_descent.nearest_vectors(df.limit(0)).collect() == []
    assert nn_descent.nearest_vectors(df.filter("vec_id = 1"), every=1).collect() == []


def test_neighbours_recall(spark, monkeypatch):
    """Many small blocks, so that the descent has work to do."""
    monkeypatch.setattr(nn_descent, "BLOCK", 64)
    rng = np.random.default_rng(6)
    points = (rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = found_nearest(nn_descent.nearest_vectors(df, every=20)), brute_nearest(rows, 10, 20)
    recall = np.mean([len({x[1] for x in got[q]} & {x[1] for x in want[q]}) / 10 for q in want])
    assert got.keys() == want.keys() and recall >= 0.9
    for q, w in got.items():
        assert [x[0] for x in w] == list(range(1, 11)) and all(d == pytest.approx(math.dist(rows[q][1], rows[i][1]), rel=1e-12) for _, i, d in w)


def brute_words(rows, least=7):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= least
    n = {w: c for w, c in count.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("chunk", [spelling.CHUNK, 40])
def test_variants(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.randint(6, 11))) for _ in range(12)]
    letters = "abcdeéÀ"

    def edit(w):
        at = rng.randrange(len(w) + 1)
        return rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]])

    texts = [None, "", " ", "x" * 20_000, "x" * 20_000 + " " + "x" * 19_999, "123 short"]
    for k in range(400):
        words = [rng.choice(base[: 1 + k % 12]) for _ in range(12)] + [edit(rng.choice(base)) for _ in range(5)] + [edit(edit(base[0]))]
        texts.append(rng.choice([" ", "\n", "-"]).join(w.title() if rng.random() < 0.1 else w for w in words))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, texts[20]), (5, texts[20])]
    df = spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], "doc_id long, text string, word string, form string, n int").repartition(4)
    want = brute_words(rows)
    assert {r.word: tuple(r[1:]) for r in spelling.group_variants(df).collect()} == want
    assert sum(v[0] is not None for v in want.values()) > 20
    assert spelling.group_variants(df.limit(0)).collect() == []


def test_one_edit():
    def letters(w):
        return np.array([[ord(c) for c in w]])

    cases = [("abc", "abd", 1), ("abc", "acb", 0), ("abc", "abc", 0), ("abc", "abxc", 1), ("aab", "aaab", 1), ("abc", "bcda", 0), ("abc", "xabc", 1), ("abc", "abcx", 1), ("abc", "axbx", 0)]
    assert all(bool(spelling.one_edit(letters(a), letters(b))[0]) == bool(w) for a, b, w in cases)


def test_long_chain(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(17)], "word string, form string")
    assert {r.root for r in spelling.follow(links).collect()} == {"w17"}


def brute_clusters(rows, count, rounds, width):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), rows[k][1], k) for k, (i, v) in enumerate(rows) if i is not None and (i, v) in rows and v and len(v) == width and all(x is not None and math.isfinite(x) for x in v))
    spots = [[math.floor(Fraction(x) * 256) for x in v] for _, v, _ in hashed[:count]]
    for turn in range(rounds + 1):
        place = [min((sum((a - b) ** 2 for a, b in zip(v, s, strict=True)), c) for c, s in enumerate(spots)) for _, v in kept]
        if turn < rounds:
            for c in range(len(spots)):
                own = [v for (_, v), p in zip(kept, place, strict=True) if p[1] == c]
                spots[c] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else spots[c]
    most = 2**63 - 1
    total = Counter()
    for d, c in place:
        total[c] += d
    digest = [hashlib.sha256(",".join(map(str, s)).encode()).hexdigest() for s in spots]
    facts = [(i, c, min(d, most), min(total[c], most), min(sum(total.values()), most), digest[c]) for (i, _), (d, c) in zip(kept, place, strict=True)]
    return sorted(facts, key=str)


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e200])
def test_centroids(spark, scale):
    """Also numbers that neither doubles nor longs hold once they are squared."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 5)) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(np.r_[base, base[:8], base[:10] + 0.01 * scale])]
    rows += [(3, base[0].tolist()), (3, base[0].tolist()), (None, base[1].tolist()), (90, None), (91, [1.0]), (92, [math.nan] * 5), (93, [None] * 5), (94, [math.inf] * 5), (95, [0.0] * 5)]
    df = spark.createDataFrame(vector_rows(rows), VECTORS).repartition(4)
    got = centroids.cluster_vectors(df, count=6, rounds=3, width=5)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 6, 3, 5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert len(centroids.cluster_vectors(df, count=600, rounds=1, width=5).select("cluster").distinct().collect()) <= 51
    assert centroids.cluster_vectors(df.limit(0)).collect() == []


def test_moved_products():
    rng = np.random.default_rng(2)
    x, old = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, (4, 7))
    new = old.copy()
    new[1, 2:4] += 5
    new[3, 0] -= 9
    assert (centroids.moved(x, x @ old.T, old, new) == x @ new.T).all()
