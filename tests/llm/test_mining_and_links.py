"""Hard negatives, importance resampling and SimHash links against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from fluxora.llm import negatives, resampling, simhash

VECTORS = "vec_id long, embedding array<double>, label int"
DOCS = "doc_id long, text string"


def mined(rows, k=5, n=10):
    """(anchor, positive, rank, negative, positive score, negative score) by brute force."""
    sound = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None:
            continue
        if any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        sound.append((vec_id, [math.floor(256 * x) for x in v], label))
    out = []
    for a in sorted({r[0] for r in sound if r[0] % 100 == 0}):
        own = max((v, label) for i, v, label in sound if i == a)
        scored = [
            (-sum(x * y for x, y in zip(v, own[0])), i, label) for i, v, label in sound if i != a
        ]
        scored.sort()
        for p_score, p, _ in [s for s in scored if s[2] == own[1]][:k]:
            fits = [
                s for s in scored if s[2] != own[1] and 30 * -p_score <= 100 * -s[0] <= 90 * -p_score
            ]
            out += [(a, p, r + 1, i, -p_score, -s) for r, (s, i, _) in enumerate(fits[:n])]
    return Counter(out)


def sample_vectors():
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 0.2, (4, 6))
    rows = [
        (i, [float(x) for x in middles[i % 4] + rng.normal(0, 0.1, 6)], int(i % 4)) for i in range(500)
    ]
    rows += [(i, rows[3][1], i % 5) for i in range(500, 620)]  # ties
    rows += [(17, rows[17][1], 1), (17, rows[17][1], 1), (100, rows[9][1], 2)]  # repeated ids
    rows += [(700, [0.0] * 6, 1), (800, [0.1, 0.2], 1), (900, [], 2)]  # zero, short, empty
    rows += [
        (None, rows[0][1], 1), (1000, None, 1), (1100, [1.0, None], 1),
        (1200, [float("nan")] * 6, 1), (1300, [float("inf")] * 6, 1), (1400, rows[0][1], None),
    ]
    return rows


@pytest.mark.parametrize("references", [0, 3, 12])
def test_hard_negatives(spark, references):
    rows = sample_vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"v": F.lit("x"), "rank": F.lit(1), "aims": F.lit(0)})
    config = negatives.Mining(references=references, shard_rows=120, block_rows=2)
    found = negatives.hard_negatives(df, config)
    assert Counter(tuple(r) for r in found.collect()) == mined(rows)


def test_hard_negatives_of_large_components_and_empty_table(spark):
    rows = [(100 * i, [1e6 * (i - 3), 2e5 + i, 1e5], i % 2) for i in range(9)]  # sums beyond 2**52
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS))
    assert Counter(tuple(r) for r in found.collect()) == mined(rows)
    none = negatives.hard_negatives(spark.createDataFrame([], VECTORS))
    assert none.collect() == []


def test_score_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    data = rng.integers(-300, 300, (200, 8))
    data[5], data[6], data[7] = data[4], -data[4], 0  # equal, opposite, zero
    directions = np.linalg.qr(rng.normal(size=(8, 8)))[0][:5]
    directions[0] = data[4] / np.linalg.norm(data[4])
    norms, angles = negatives.angles_to(data.astype(float), directions)
    points = negatives.Points(np.arange(200), np.zeros(200), data, norms, angles)
    lower, upper = negatives.score_bounds(points, points)
    scores = data @ data.T
    assert (lower <= scores).all() and (scores <= upper).all()
    # The interval of a row that stands on a reference is narrow.
    assert upper[4, 5] - lower[4, 5] < 0.01 * norms[4] ** 2


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def drawn(docs, targets, least=20, percent=10):
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    features = [(i, [bucket(w) for w in words_of(t)]) for i, t in docs]
    s = Counter(b for _, f in features for b in f)
    t = Counter(bucket(w) for x in targets for w in words_of(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))
    )
    rows = []
    for i, f in features:
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        if i is None:
            rows.append([i, len(f), weight, None, None])
            continue
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return Counter(map(tuple, rows))


def test_resampling(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"Wort{i}é" if i % 7 == 0 else f"w{i}x" for i in range(500)]
    docs = [
        (int(i), " ".join(rng.choice(vocabulary, int(rng.integers(1, 60))))) for i in rng.permutation(900)
    ]
    long = ", ".join(f"Lang{i % 97}" for i in range(40_000))
    docs += [(1000, None), (1001, ""), (1002, " \n;"), (1003, long), (None, long), (5, docs[0][1])]
    docs += [(2000, long)] * 40  # a repeated row
    targets = ["w1x W2X w3x Wort7é", None, "w1x " * 30]
    df = spark.createDataFrame(docs, DOCS).withColumns({"score": F.lit("x"), "n": F.lit(1), "range": F.lit(2)})
    aims = spark.createDataFrame([(t,) for t in targets], "text string").withColumn("doc_id", F.lit("q"))
    config = resampling.Resampling(accuracy=50)  # a coarse sketch: brackets must widen
    found = resampling.resampled(df, aims, config)
    assert Counter(tuple(r) for r in found.collect()) == drawn(docs, targets)


def test_resampling_of_ties_and_empty_tables(spark):
    same = [(i, "one two " * 20) for i in range(300)]
    empty = spark.createDataFrame([], "text string")
    found = resampling.resampled(spark.createDataFrame(same, DOCS), empty)
    assert Counter(tuple(r) for r in found.collect()) == drawn(same, [])
    assert resampling.resampled(spark.createDataFrame([], DOCS), empty).collect() == []
    few = [(i, "a b") for i in range(5)]
    assert Counter(tuple(r) for r in resampling.resampled(spark.createDataFrame(few, DOCS), empty).collect()) == drawn(few, [])


@pytest.mark.parametrize("wanted", [1, 37, 500, 1999, 2000])
def test_cutoff_place(spark, wanted):
    rows = [(int(s), i) for i, s in enumerate(np.random.default_rng(9).integers(0, 40, 2000))]
    df = spark.createDataFrame(rows, "score long, doc_id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for accuracy in (10, 10_000):
        assert resampling.cutoff(df, wanted, 2000, accuracy) == order[wanted - 1]


def print_of(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    width = min(3, len(words))
    hashed = [
        xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42)
        for k in range(len(words) - width + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def linked(docs):
    """doc_id -> component over all pairs."""
    prints = [(i, print_of(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, f) in enumerate(prints):
        for j, g in prints[:n]:
            if (f ^ g).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def test_simhash_components(spark):
    rng = np.random.default_rng(4)
    docs = []
    for i in range(60):
        words = [f"Word{x}" for x in rng.integers(0, 400, 300)]
        for k in range(6):
            changed = list(words)
            for at in rng.integers(0, 300, k):
                changed[at] = f"other{k}"
            docs.append((len(docs) * 3, " ".join(changed)))
    long = " ".join(f"w{i % 991}" for i in range(70_000))
    docs += [(5000, None), (5001, ""), (5002, " \t"), (5003, long), (5004, long.upper()), (5005, "one two")]
    docs += [(7, docs[0][1]), (7, docs[20][1]), (None, docs[0][1]), (5003, long), (5006, "é\x85x ONE")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"fp": F.lit("x"), "node": F.lit(1), "shard": F.lit(0)})
    for config in (simhash.Linking(), simhash.Linking(tree_rows=40, slice_rows=25)):
        found = simhash.simhash_components(df, config).collect()
        expected = linked(docs)
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == Counter(
            (i, f"{print_of(t):016x}", expected.get(i)) for i, t in docs
        )
    assert len(set(expected.values())) < len(expected) - 100  # near copies do link
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).collect() == []


def test_trees_find_every_link():
    rng = np.random.default_rng(8)
    middle = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 9, 1500)]
    prints = np.unique(np.concatenate([
        rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2),
        middle ^ np.array(flips, dtype=np.uint64),
    ]))
    prints = rng.permutation(prints)
    tree = simhash.grow(prints)
    assert sorted(tree.members.tolist()) == list(range(1, len(prints)))
    found = {
        (int(a), int(b)) for who, node in simhash.walk(tree, prints, 3) for a, b in zip(who, node)
    }
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(apart <= 3))}


def test_links_of_a_slice():
    frame = pd.DataFrame({"shard": 0, "tree": 0, "fp": [0, 1, 3, 1 << 40], "node": [4, 2, 9, 7]})
    row = simhash.tree_row(frame)
    links = simhash.links_in(row, frame[["fp", "node"]], 3)
    assert sorted(map(tuple, links.to_numpy().tolist())) == [(4, 2), (7, 2), (9, 2)]
    assert not len(simhash.links_in(row.iloc[:0], frame, 3))
