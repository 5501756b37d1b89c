"""Centroids, top-k search and resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairnflow.llm import centroids, resample, topk

NAN, INF = float("nan"), float("inf")
ODD = "vec_id long, embedding array<double>, cluster int, distance long, id string, q long, rank int, v double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 8, "x", 9, 1, 0.5) for i, v in rows], ODD)


def ints(v, scale):
    """The integers of a vector that takes part, else None."""
    if v is None or any(x is None or not math.isfinite(x) or not abs(x * scale) < 2**63 for x in v):
        return None
    return [math.floor(x * scale) for x in v]


def random_vectors(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    return [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(n)]


def odd_vectors(dims):
    made = random_vectors(5, 120, dims)
    rows = list(enumerate(made))
    rows += [(7, made[7]), (7, made[7]), (7, made[8]), (100, made[3]), (100, made[100]), (None, made[9]), (200, made[50]), (300, [0.0] * dims)]
    rows += [(400, None), (401, []), (500, []), (402, [NAN, *made[1][1:]]), (403, [None, *made[1][1:]]), (404, [INF, *made[1][1:]]), (405, made[1][: dims // 2]), (600, made[2][: dims // 2]), (406, [1e300, *made[1][1:]])]
    return rows + [(i, made[11]) for i in range(1000, 1400)]  # a third and more of all rows are copies


# -- 11 -----------------------------------------------------------------------------------


def brute_centroids(rows, k, rounds, dims, scale, seed):
    kept = [(i, x) for i, v in rows if (x := ints(v, scale)) is not None and len(x) == dims]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [x for _, x in sorted(kept, key=key)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        at = [[sum(col) // len(col) for col in zip(*mine)] if (mine := [x for (_, x), n in zip(kept, of) if n == c]) else at[c] for c in range(len(at))]
    told = [(i, *nearest(x)) for i, x in kept]
    of, total = Counter(), sum(d for _, d, _ in told)
    for _, d, n in told:
        of[n] += d
    long = lambda v: v if v < 2**63 else None
    return sorted([(i, n, long(d), long(of[n]), long(total), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, d, n in told], key=repr)


def told(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


CLUSTERED = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_centroids_are_brute_forces(spark):
    rows = odd_vectors(16)
    got = centroids.cluster(table(spark, rows), k=9, rounds=4, dims=16)
    assert got.columns == list(CLUSTERED)
    assert told(got, *CLUSTERED) == brute_centroids(rows, 9, 4, 16, 256, "2")


@pytest.mark.parametrize("spread", [2.0**18, 2.0**40])
def test_centroids_of_large_components(spark, spread):
    """Beyond 32 and beyond 64 bits: still exact, and null where a distance isn't a long."""
    rows = list(enumerate(random_vectors(2, 60, 10, spread)))
    got = told(centroids.cluster(table(spark, rows), k=5, rounds=3, dims=10), *CLUSTERED)
    assert got == brute_centroids(rows, 5, 3, 10, 256, "2")
    assert (got[0][4] is None) == (spread > 2**30)


def test_centroids_few_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-0.001, 0.0])]
    assert told(centroids.cluster(table(spark, rows), k=9, dims=2), *CLUSTERED) == brute_centroids(rows, 9, 5, 2, 256, "2")
    empty = centroids.cluster(table(spark, [(1, None)]), k=9, dims=2)
    assert empty.columns == list(CLUSTERED) and empty.count() == 0


def test_partial_distances_abandon_only_what_is_above():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-3, 4, (4000, 40)), rng.integers(-3, 4, (30, 40))
    c[17] = c[4]  # a tie everywhere
    number, distance = centroids.nearest(x, c, rng.permutation(40))
    whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


# -- 12 -----------------------------------------------------------------------------------


def brute_topk(rows, k, scale, every):
    kept = [(i, x) for i, v in rows if (x := ints(v, scale)) is not None]
    out = []
    for n, (i, x) in enumerate(kept):
        if i is not None and i % every == 0:
            near = [(-min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1), j is None, j or 0, j) for m, (j, y) in enumerate(kept) if m != n and len(x) == len(y)]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(near)[:k])]
    return sorted(out, key=repr)


FOUND = ("query_id", "rank", "vec_id", "score")


def test_topk_is_brute_forces(spark):
    rows = odd_vectors(12)
    df = table(spark, rows)
    got = topk.search(df, df["vec_id"] % 20 == 0, k=7)
    assert got.columns == list(FOUND)
    assert told(got, *FOUND) == brute_topk(rows, 7, 1024, 20)


def test_topk_in_many_shards_and_levels(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 256)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    rows = odd_vectors(8)
    df = table(spark, rows)
    assert told(topk.search(df, df["vec_id"] % 50 == 0), *FOUND) == brute_topk(rows, 10, 1024, 50)


@pytest.mark.parametrize("spread", [2.0**15, 2.0**45])
def test_topk_of_large_components(spark, spread):
    """Products beyond what doubles hold, and scores beyond longs."""
    rows = list(enumerate(random_vectors(4, 80, 6, spread)))
    df = table(spark, rows)
    assert told(topk.search(df, df["vec_id"] % 10 == 0, k=5), *FOUND) == brute_topk(rows, 5, 1024, 10)


def test_topk_tiles_hold_ties(monkeypatch):
    monkeypatch.setattr(topk, "TILE", 8)
    rng = np.random.default_rng(1)
    x, q = rng.integers(-2, 3, (500, 4)), rng.integers(-2, 3, (40, 4))
    at, place, score = topk.tiled(q, x, 6)
    want = [(i, int(p), int(s)) for i, row in enumerate(q @ x.T) for s, p in sorted(zip(row, range(500)), key=lambda t: (-t[0], t[1]))[:6]]
    assert list(zip(at.tolist(), place.tolist(), score)) == [(i, p, s) for i, p, s in want]


def test_topk_without_queries(spark):
    df = table(spark, [(1, [1.0])])
    assert topk.search(df, df["vec_id"] % 100 == 0).count() == 0
    df = table(spark, [(100, [1.0])])  # nothing but itself
    assert topk.search(df, df["vec_id"] % 100 == 0).count() == 0


# -- 13 -----------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, aims, orders, buckets, percent, least, seed):
    def features(text):
        w = WORD.findall((text or "").translate(str.maketrans(resample.UPPER, resample.LOWER)))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in aims for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets))))
    scored = []
    for i, n, f in each:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = percent * len(able) // 100
    out = [(r[0], *r[2:], n + 1 if n < drawn else None) for n, r in enumerate(able)] + [(r[0], *r[2:], None) for r in scored if r[1] < least]
    return sorted(out, key=repr)


DRAWN = ("doc_id", "n_features", "weight", "score", "rank")


def texts(spark):
    rng = random.Random(8)
    vocabulary = ["the", "The", "CAFÉ", "café", "42", "naïve", "字", "x", "ß", "İ", "don't", "a-b", "\x7fdel"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(1, None), (2, ""), (None, "no id " * 30), (None, None), (3, "\t\n--"), (9, docs[40][1]), (9, docs[40][1]), (10, "long " * 30_000)]
    docs += [(77, "one text many times over and over " * 4)] * 80
    aims = ["the café 42", None, "", "字 字 x"]
    d = spark.createDataFrame([(i, t, 1, 2, 3, "z") for i, t in docs], "doc_id long, text string, row long, bucket int, rank long, id string")
    return docs, aims, d, spark.createDataFrame([(1, t, 5) for t in aims], "item_id long, text string, row long")


@pytest.mark.parametrize("orders", [1, 3])
def test_resample_is_brute_forces(spark, orders):
    docs, aims, d, a = texts(spark)
    got = resample.resample(d, a, orders=orders, buckets=50, percent=30)
    assert got.columns == list(DRAWN)
    assert told(got, *DRAWN) == brute_resample(docs, aims, orders, 50, 30, 20, "2024")


def test_resample_empty_tables(spark):
    docs, aims, d, a = texts(spark)
    assert resample.resample(d.limit(0), a).count() == 0
    assert told(resample.resample(d, a.limit(0)), *DRAWN) == brute_resample(docs, [], 1, 10_000, 10, 20, "2024")


def test_resample_moves_no_texts_for_words_alone(spark):
    """For single words only counts and one small row of a document are dealt."""
    _, _, d, _ = texts(spark)
    plan = resample.position_table(d.select("row", "doc_id", "text"), "text", 1, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    plan = resample.position_table(d.select("row", "doc_id", "text"), "text", 2, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan
