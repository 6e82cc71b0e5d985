"""Sampling, row numbering, batches and sequence encoding."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.operators import encode as enc
from tessel.operators import sampling as R


def ids(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "uid long")


def test_sample_is_partition_invariant(spark):
    df = ids(spark, 300)
    base = [r.uid for r in R.sample_seeded(df, 30, 123).orderBy("pos").collect()]
    for n in (1, 4, 16):
        assert [r.uid for r in R.sample_seeded(df.repartition(n), 30, 123).orderBy("pos").collect()] == base
    assert len(set(base)) == 30


def test_shuffle_is_a_permutation(spark):
    out = R.shuffle_rows(ids(spark, 257), 7, 1).collect()
    assert sorted(r.pos for r in out) == list(range(257))


def test_batches_last_short_or_dropped(spark):
    df = ids(spark, 130).repartition(5)
    sizes = {r.batch: r.n for r in enc.assign_batches(df, 64, ["uid"]).groupBy("batch")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 64, 1: 64, 2: 2}
    sizes = {r.batch: r.n for r in enc.assign_batches(df, 64, ["uid"], drop_last=True).groupBy("batch")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 64, 1: 64}


def test_batches_follow_order(spark):
    out = enc.assign_batches(ids(spark, 100).repartition(7), 10, ["uid"]).collect()
    assert all(r.batch == r.uid // 10 for r in out)


def test_odd_one_out_properties(spark):
    import numpy as np
    rng = np.random.default_rng(11)
    pts = spark.createDataFrame([(i, rng.random(2).tolist()) for i in range(80)], "uid long, vec array<double>")
    sets = R.odd_one_out(pts, 6, 123).collect()
    by = {}
    for r in sets:
        by.setdefault(r["index"], []).append(r)
    assert len(by) == 6
    for rows in by.values():
        assert len({r.uid for r in rows}) == 4
        assert sum(r.label for r in rows) == 1
        assert [r.label for r in sorted(rows, key=lambda r: r.pos)] == [0, 0, 0, 1]


def truncate_loop(la, lb, budget):
    a, b = la, lb
    while a + b > budget:
        if a > b:
            a -= 1
        else:
            b -= 1
    return a, b


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 25), st.integers(0, 25), st.integers(1, 20))
def test_pair_budget_equals_one_at_a_time(la, lb, budget):
    ka = min(la, max((budget + 1) // 2, budget - lb))
    kb = min(lb, max(budget // 2, budget - la))
    assert (ka, kb) == truncate_loop(la, lb, budget)


def test_encode_fixed_length(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, "z " * 50)], "k long, text string")
    vocab = enc.fit_vocab(df, "text", 10)
    out = {r.k: r for r in enc.encode(df, vocab, ["k"], "text", 8).collect()}
    assert all(len(r.ids) == 8 and len(r.mask) == 8 for r in out.values())
    assert out[2].ids == [2, 3, 0, 0, 0, 0, 0, 0] and out[2].mask == [1, 1, 0, 0, 0, 0, 0, 0]
    assert out[3].mask == [1] * 8 and out[3].ids[-1] == 3


def test_hash_encode_unit_length(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "!!!")], "k long, text string")
    out = {r.k: r.vec for r in enc.hash_encode(df, "k", "text", 16).collect()}
    assert abs(sum(x * x for x in out[1]) - 1.0) < 1e-9
    assert out[2] == [0.0] * 16


def test_embed_batch_runs(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "k long, text string")
    out = enc.embed(df, "text", batch_size=8).collect()
    assert len(out) == 50 and all(len(r.vec) == 64 for r in out)


def test_rows_sharing_a_key_keep_a_row_each(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (1, "c"), (2, None)], "k long, text string")
    vocab = enc.fit_vocab(df, "text", 10)
    assert sorted(r.ids for r in enc.encode(df, vocab, ["k"], "text", 6).collect()) == sorted(
        [[2, 5, 6, 3, 0, 0], [2, 4, 3, 0, 0, 0], [2, 4, 3, 0, 0, 0], [2, 3, 0, 0, 0, 0]])
    assert enc.hash_encode(df, "k", "text", 16).count() == 4
    pairs = df.select("k", F.col("text").alias("premise"), F.col("text").alias("hypothesis"))
    assert enc.encode_pairs(pairs, vocab, ["k"], max_len=12).count() == 4


def test_large_vocabulary_join_equals_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5, " ".join(f"t{j % 7}" for j in range(i))) for i in range(20)] + [(9, None)], "k long, text string")
    vocab = enc.fit_vocab(df, "text", 5)
    pairs = df.select("k", F.col("text").alias("premise"), F.reverse("text").alias("hypothesis"))

    def both():
        return (sorted(map(str, enc.encode(df, vocab, ["k"], "text", 12).collect())),
                sorted(map(str, enc.encode_pairs(pairs, vocab, ["k"], max_len=16).collect())))

    want = both()
    monkeypatch.setattr(enc, "MAX_BROADCAST_VOCAB", 0)
    assert both() == want


def test_cap_rows(spark):
    df = ids(spark, 50).repartition(4)
    assert [r.uid for r in R.cap_rows(df, 5, ["uid"]).collect()] == [0, 1, 2, 3, 4]
    assert R.cap_rows(df, None, ["uid"]).count() == 50


def test_embed_batch_equals_direct_encoder(spark):
    import numpy as np
    texts = [f"word{i % 7} and more words {i}" for i in range(40)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: r.vec for r in enc.embed(df.repartition(3), "text", batch_size=8).collect()}
    predict = enc.numpy_text_encoder()()
    want = predict(np.array(texts, dtype=object))
    for k, t in enumerate(texts):
        assert np.allclose(got[k], want[k], atol=1e-7)


def test_random_outsiders_equals_brute_force(spark):
    import hashlib
    pts = ids(spark, 200).repartition(5)
    groups = spark.createDataFrame([(g,) for g in (3, 50, 77)], "g long")
    excluded = spark.createDataFrame([(3, 3), (3, 10), (50, 50), (77, 77), (77, 1), (77, 2), (77, 5)], "g long, uid long")

    def h(x):
        return int(hashlib.md5(f"123:odd:{x}".encode()).hexdigest()[:8], 16)

    ex = {}
    for g, u in excluded.collect():
        ex.setdefault(g, set()).add(u)
    want = {g: min((u for u in range(200) if u not in ex[g]), key=lambda u: ((h(u) + h(g)) % (1 << 32), u))
            for g in (3, 50, 77)}
    got = {r.g: r.uid for r in R.random_outsiders(pts, groups, excluded, 123).collect()}
    assert got == want


def test_sample_prefilter_is_exact(spark, monkeypatch):
    df = ids(spark, 5000).repartition(8)
    base = [r.uid for r in R.sample_seeded(df, 40, 9).orderBy("pos").collect()]
    monkeypatch.setattr(R, "PREFILTER_ROWS", 0)
    assert [r.uid for r in R.sample_seeded(df, 40, 9).orderBy("pos").collect()] == base
    assert [r.uid for r in R.sample_seeded(df, 4999, 9).orderBy("pos").collect()][:40] == base


def test_sample_beyond_the_top_n_bound(spark, monkeypatch):
    df = ids(spark, 3000).repartition(4)
    base = sorted((r.pos, r.uid) for r in R.sample_seeded(df, 1500, 9).collect())
    monkeypatch.setattr(R, "MAX_SAMPLE", 100)
    assert sorted((r.pos, r.uid) for r in R.sample_seeded(df, 1500, 9).collect()) == base


def test_outsiders_in_blocks_of_groups(spark, monkeypatch):
    pts = ids(spark, 90).repartition(3)
    groups = pts.select(F.col("uid").alias("g"))
    excluded = groups.select("g", F.col("g").alias("uid"))
    base = sorted(map(tuple, R.random_outsiders(pts, groups, excluded).collect()))
    monkeypatch.setattr(R, "MAX_SAMPLE", 20)
    assert sorted(map(tuple, R.random_outsiders(pts, groups, excluded).collect())) == base and len(base) == 90


def test_candidates_once_per_task(spark):
    """At most (E + 1) candidates per group and task, however small the Arrow batches."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        src = ids(spark, 1000).repartition(2).select(F.col("uid").alias("_u"), R.hash_int(123, "odd", F.col("uid")).alias("_h"))
        block = spark.createDataFrame([(g, g * 7, 3) for g in range(30)], "g long, _h long, _e long").toPandas()
        assert src.mapInPandas(R._smallest_keys(src, block, "g"), "g long, _u long, _k long").count() == 30 * 4 * 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def cap_case(spark, rows, n, order, monkeypatch, cut=20):
    from tessel.operators import sampling
    monkeypatch.setattr(sampling, "CAP_CUT_ROWS", cut)
    monkeypatch.setattr(sampling, "CAP_BOUNDS", 4)
    monkeypatch.setattr(sampling, "CAP_SAMPLE", 16)
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(6)
    out = sampling.cap_rows(df, n, order, top_n=0)
    return sorted(map(tuple, out.collect()), key=repr), out


def test_large_cap_equals_a_sort(spark, monkeypatch):
    import random
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 2, 3, rnd.randrange(500)]), f"s{rnd.randrange(300)}", rnd.random()) for _ in range(900)]
    for n in (1, 17, 450, 899, 900, 5000):
        got, out = cap_case(spark, rows, n, ["a", "b", "c"], monkeypatch)
        assert got == sorted(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[:n], key=repr)
    got, out = cap_case(spark, rows, 540, ["a", "b", "c"], monkeypatch)
    assert "SinglePartition" not in out.filter("a is not null")._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_large_cap_through_ties_and_equal_rows(spark, monkeypatch):
    rows = [(5, "x", 1.0)] * 300 + [(1, f"y{i}", 1.0) for i in range(100)] + [(9, "z", 2.0)] * 50
    got, _ = cap_case(spark, rows, 250, ["a"], monkeypatch)
    assert got == sorted([r for r in rows if r[0] == 1] + [(5, "x", 1.0)] * 150, key=repr)
    ties = [(1, f"t{i}", float(i)) for i in range(400)]
    got, _ = cap_case(spark, ties, 123, ["a"], monkeypatch)
    assert len(got) == 123 and len(set(got)) == 123
    assert cap_case(spark, ties, 123, ["a"], monkeypatch)[0] == got
