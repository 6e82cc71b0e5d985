"""Training step, schedule, packer and essential terms against plain loops."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tessel.llm import maxscore, packing, quality, sharding


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(sorted(rng.choice(12, 4, replace=False).tolist()), rng.random(4).round(2).tolist(), int(rng.integers(0, 2))) for _ in range(80)]
    z, n = [0.0] * 12, [0.0] * 12
    for idx, val, y in rows:
        w = {}
        for i in idx:
            w[i] = 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / (
                (quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in zip(idx, val))))
        for i, x in zip(idx, val):
            g = (p - y) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
            n[i] += g * g
    got = quality._train({"z": np.zeros(12, np.float32), "n": np.zeros(12, np.float32)},
                         pd.DataFrame({"idx": [r[0] for r in rows], "val": [r[1] for r in rows], "y": [r[2] for r in rows]}))
    assert np.allclose(got["z"], z, atol=1e-4) and np.allclose(got["n"], n, atol=1e-4)


def test_shards_equal_a_plain_schedule(spark):
    rng = np.random.default_rng(4)
    texts = ["x" * int(s) + str(k) for k, s in enumerate(rng.integers(0, 90, 150))]
    rows = [(i, texts[int(i * i) % 150]) for i in range(500)] + [(900 + i, "the same long text of many rows") for i in range(80)]
    shards, per = 5, 3
    got = {}
    for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards, 16, per).collect():
        got[r["doc_id"]] = r["shard"]
    size = Counter()
    for _, t in rows:
        size[t] += len(t.encode()) + 16
    limit = max(1, -(-sum(size.values()) // (shards * per)))

    def bundle(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return (h - (1 << 64) if h >> 63 else h) % (shards * per)

    import hashlib
    large = sorted((t for t in size if size[t] >= limit), key=lambda t: hashlib.md5(t.encode()).digest())
    item = {t: shards * per + large.index(t) if t in large else bundle(t) for t in size}
    load = Counter()
    for t in size:
        load[item[t]] += size[t]
    full, where = [0] * shards, {}
    for i, s in sorted(load.items(), key=lambda x: (-x[1], x[0])):
        k = min(range(shards), key=lambda j: (full[j], j))
        where[i], full[k] = k, full[k] + s
    assert got == {i: where[item[t]] for i, t in rows} and large


def plain_windows(docs, window):
    """Windows of a shard by an index that scores every document for every seed."""
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))

    def score(seed, d):
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * docs[d].count(t) * 2.2 / (docs[d].count(t) + 1.2 * (0.25 + 0.75 * len(docs[d]) / avg))
                   for t in set(docs[seed]) if df[t] > 1 and t in docs[d])

    unused, pieces, seq, fill, queue, seed = set(range(n)), [], 0, 0, [], -1
    while unused:
        d = next((x for x in queue if x in unused), None)
        if d is None:
            d = seed = min(unused)
        unused.discard(d)
        start, opened = 0, False
        while start < len(docs[d]):
            take = min(window - fill, len(docs[d]) - start)
            pieces.append((d, start, start + take, seq, fill))
            fill, start = fill + take, start + take
            if fill == window:
                seq, fill, opened = seq + 1, 0, True
        if opened:
            seed = d
        if seed == d:
            found = [(round(-score(d, x), 4), x) for x in unused]
            queue = [x for s, x in sorted(found) if s < 0]
    return pieces


def test_packer_equals_a_plain_one(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(packing, "FEW", 3)
    for common in (0, 4):
        monkeypatch.setattr(packing, "COMMON", common)
        for trial in range(12):
            docs = [rng.integers(0, 60, int(rng.integers(1, 25))).tolist() for _ in range(40)]
            off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            got = packing.Packer(32).shard(np.array(sum(docs, []), np.uint16), off)
            assert [tuple(map(int, p)) for p in got] == plain_windows(docs, 32), (common, trial)


def test_essential_terms_leave_nothing_out(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(maxscore, "BLOCK", 64)
    ids = rng.permutation(700)
    vecs = np.floor(rng.normal(size=(700, 24)) * 40 * rng.random((700, 1)))
    vecs[5:40] = vecs[5]
    shard, traversed = maxscore.Shard(ids, vecs), 0
    for own in range(0, 700, 9):
        at = int(np.flatnonzero(ids == own)[0])
        score = vecs @ vecs[at]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != own][:20]
        for threshold in (-np.inf, float(score[order[-1]])):
            got, best = shard.search(own, vecs[at], 20, threshold)
            assert got.tolist() == ids[order].tolist() and best.tolist() == score[order].tolist()
            traversed += 1
    assert shard.products < 0.6 * traversed * 700 * 24
