"""Centroids, embedding near-duplicates and the prefix trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import plane_hash, prefix_trie, shallot

VECTORS = "vec_id long, embedding array<double>, near int, v string, uid string, label int, n long"


def vector_rows(vectors, first=0):
    return [(first + i, None if x is None else [None if y is None else float(y) for y in x], 7, "clash", "clash", 1, 2) for i, x in enumerate(vectors)]


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


# ------------------------------------------------------------- clustering
def brute_clusters(rows, dims, k, rounds, seed="3"):
    bound = shallot.largest_component(dims)
    kept = [(r[0], [math.floor(max(-bound, min(bound, 1024 * x))) for x in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        near = [i for _, i in assign()]
        at = [[sum(col) // len(col) for col in zip(*(v for (_, v), n in zip(kept, near) if n == i))] or c for i, c in enumerate(at)]
    found = assign()
    per = [sum(d for d, i in found if i == c) for c in range(len(at))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    fit = lambda x: x if x < 2**63 else None
    return sorted(((r[0], i, d, fit(per[i]), fit(sum(per)), sha[i]) for r, (d, i) in zip(kept, found)), key=repr)


@pytest.mark.parametrize("kind", ["random", "ties", "few", "awkward", "one"])
def test_clusters_equal_plain_kmeans(spark, kind):
    rng = np.random.default_rng(3)
    dims, k = 4, 5
    if kind == "random":
        rows = vector_rows(rng.standard_normal((600, dims)) + rng.integers(0, 4, (600, 1)))
    elif kind == "ties":  # a grid: many equal distances and equal vectors
        rows = vector_rows(rng.integers(-2, 3, (400, dims)) / 1024)
    elif kind == "few":
        rows = vector_rows(rng.standard_normal((3, dims)))
    elif kind == "one":
        rows, k = vector_rows(rng.standard_normal((50, dims))), 1
    else:
        rows = vector_rows([[1e300, 0, 0, 0], [-1e300, 1, 1, 1], [1e-320, -0.0, 0, 0], None, [], [1, 2, 3], [1, None, 2, 3], [math.nan, 0, 0, 0],
                            [math.inf, 0, 0, 0], *rng.standard_normal((60, dims))])
        rows += [rows[0], rows[-1], (None, [1.0, 2.0, 3.0, 4.0], 0, "", "", 0, 0), (None, [0.5, 2.0, 3.0, 4.0], 0, "", "", 0, 0)]
    got = sorted((tuple(r) for r in shallot.clusters(frame(spark, rows), k=k, dims=dims, rounds=6).collect()), key=repr)
    assert got == brute_clusters(rows, dims, k, 6)


def test_no_vectors_no_clusters(spark):
    for rows in ([], vector_rows([None, [1.0]])):
        out = shallot.clusters(frame(spark, rows), dims=4)
        assert out.count() == 0
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_search_prunes_but_keeps_the_nearest():
    rng = np.random.default_rng(5)
    at = (rng.standard_normal((40, 16)) * 1000).astype(np.int64)
    x = np.repeat(at, 20, axis=0) + rng.integers(-300, 300, (800, 16))
    c = shallot.Centroids(at.tolist(), None)
    all_ = ((x[:, None] - at[None]) ** 2).sum(2)
    a, b, da, db = shallot.search(x, rng.integers(0, 40, 800), rng.integers(0, 40, 800) * 0 + 39, c)
    assert (a == all_.argmin(1)).all() and (da == all_.min(1)).all() and (db == np.sort(all_, 1)[:, 1]).all()


# ---------------------------------------------------- embedding duplicates
def brute_links(rows, threshold):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, up = defaultdict(set), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    units = [np.array(r[1]) / np.abs(r[1]).max() if usable(r[1]) else None for r in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(links[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def found_links(df, **settings):
    return sorted((tuple(r) for r in plane_hash.near_duplicates(df, **settings).collect()), key=repr)


@pytest.mark.parametrize("block", [256, 16])  # 16: crowded codes, balls and block pairs
def test_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(7)
    hot, centres = rng.standard_normal(24), rng.standard_normal((30, 24))
    vectors = [hot + 0.05 * rng.standard_normal(24) for _ in range(150)] + [hot * s for s in (1, 1, 1, 3.5, 1e200, 1e-200)]
    vectors += [c + s * rng.standard_normal(24) for c in centres for s in (0.0, 0.1, 0.2, 0.2)]
    vectors += [rng.standard_normal(24) for _ in range(100)] + [rng.standard_normal(n) for n in (1, 1, 7, 7)] + [[2.0], [-3.0]]
    vectors += [None, [], [0.0] * 24, [math.nan] * 24, [math.inf] + [0.0] * 23, [None] * 24, [-0.0] * 24]
    rows = vector_rows(vectors, first=10)
    rows += [rows[0], rows[-1], (None, hot.tolist(), 0, "", "", 0, 0), (None, rng.standard_normal(5).tolist(), 0, "", "", 0, 0), (3, (-hot).tolist(), 0, "", "", 0, 0)]
    assert found_links(frame(spark, rows), recall=0.99999, block=block) == brute_links(rows, 0.9)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    pairs = []
    for _ in range(400):  # pairs at a cosine just over 0.9, the hardest ones
        a = rng.standard_normal(64)
        b = rng.standard_normal(64)
        b -= a * (a @ b) / (a @ a)
        pairs += [a / np.linalg.norm(a), 0.901 * a / np.linalg.norm(a) + math.sqrt(1 - 0.901**2) * b / np.linalg.norm(b)]
    out = plane_hash.near_duplicates(frame(spark, vector_rows(pairs))).collect()
    assert all(r.n_links <= 1 for r in out)
    assert sum(r.n_links for r in out) / len(out) >= 0.95


def test_no_vectors_no_links(spark):
    assert found_links(frame(spark, [])) == []
    assert found_links(frame(spark, vector_rows([None, [0.0]]))) == [(0, 0, 0, True), (1, 0, 1, True)]


def test_table_shape_reaches_its_recall():
    p = 1 - math.acos(0.9) / math.pi
    for n in (0, 1, 50, 10**4, 10**6, 10**9):
        bits, tables = plane_hash.table_shape(n, 0.9, 0.98, 32)
        assert 1 - (1 - p**bits) ** tables >= 0.98


# ------------------------------------------------------------ prefix trie
TURNS = "conv_id long, turn long, role string, text string, depth string, name string"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved, out = {}, {}, []
    for n in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = (len(members[n]) - 1) * words + sum(saved[k] for k in kids[n])
        ids = ",".join(map(str, sorted(ends[n])))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(1, 140):
        for t in range(rng.integers(1, 14)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"word {rng.integers(0, 2) if t else 0} x", "clash", "clash"))
    rows += [(200, t, "u", f"long {t % 3}", "", "") for t in range(70)] + [(220, t, "u", f"long {t % 3}", "", "") for t in range(65)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_awkward_rows(spark):
    rows = [(20, None, None, None, None, None), (20, 1, "", "", "", ""), (20, 1, "b", "tie", "", ""), (20, 1, "a", "tie", "", ""),
            (20, 1, "a", "tie", "", ""), (21, 5, "u", "\t \n", "", ""), (22, -3, "u", "w " * 300_000, "", ""), (23, None, "u", "w " * 300_000, "", ""),
            (None, 1, "u", "lost", "", ""), (19, 0, "u", None, "", ""), (0, 0, "u", "zero", "", ""), (1, 0, "u", "one\x0btwo\x85three", "", "")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_one_hot_conversation_text(spark):
    rows = [(c, t, "u", f"same {t}", "", "") for c in range(100, 400) for t in range(3)] + [(c, 0, "u", f"other {c}", "", "") for c in range(400, 430)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_no_turns_no_nodes(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "u", "x", "", "")]) == []
    only_head = [(c, 0, "u", "x", "", "") for c in range(1, 60)]  # some rebuilt conversations have no turn
    assert trie_of(spark, only_head) == brute_trie(only_head)


def test_names_do_not_mix_role_and_text(spark):
    d = spark.createDataFrame([(1, 0, "ab", "c", "", ""), (2, 0, "a", "bc", "", "")], TURNS)
    assert prefix_trie.ordered_turns(d).select("sym").distinct().count() == 2
    assert prefix_trie.ordered_turns(d).agg(F.max("pos")).first()[0] == 0
