"""Whitening, byte-level BPE and collocations against brute force and the library, and their odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessel.llm import bytebpe, phrases, queries, tokens, whitening

SF = "/root/testdata/sf0.001"
RANKS = tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken")


# ---------------------------------------------------------------------- 11

def numpy_whitened(rows, components=4):
    kept = [(i, np.floor(256 * np.array(v, float)) + 0) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.stack([v for _, v in kept])
    once = np.unique(x, axis=0)
    y = once - once.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(once))
    e, u = e[::-1], u[:, ::-1]
    z = (x - once.mean(axis=0)) @ u[:, :components] / np.sqrt(e[:components])
    dev = [sum((len(once) * int(a) - int(s)) ** 2 for a, s in zip(v, once.sum(axis=0))) for _, v in kept]
    return [i for i, _ in kept], z, e / e.sum(), dev, len(once)


def test_whitening_matches_an_eigen_solver(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(300)
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    rows += [rows[0], (None, rows[1][1]), (-1, None), (-2, [float("nan")] + [0.0] * 63), (-3, [None] + [0.0] * 63), (-4, [float("inf")] + [0.0] * 63)]
    given = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows],
                                  "vec_id long, embedding array<double>, component int, n int, x double").repartition(5)
    got = whitening.whitened(given).collect()
    ids, z, share, dev, n = numpy_whitened(rows)
    assert Counter(r["vec_id"] for r in got) == Counter({i: 4 * c for i, c in Counter(ids).items()})
    at = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in got:
        k, c = at[r["vec_id"]], r["component"] - 1
        signs.setdefault(c, np.sign(r["whitened"] * z[k, c]))
        assert abs(r["whitened"] * signs[c] - z[k, c]) < 1e-9 and r["deviation"] == dev[k] and r["n"] == n
        assert abs(r["explained"] - share[c]) < 1e-12 and r["identity_error"] < 1e-10


def test_whitening_of_few_directions_and_of_nothing(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = spark.createDataFrame([(i, [i * 1.0, i * 2.0, 5.0]) for i in range(9)] + [(20, [1.0])], schema)
    assert {r["component"] for r in whitening.whitened(line).collect()} == {1, 2}
    flat = whitening.whitened(spark.createDataFrame([(i, [i * 1.0, i * 2.0, 5.0]) for i in range(9)], schema)).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12


def test_whitening_of_large_numbers_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-9, 9, 5) + 2.0 ** 40).tolist()) for i in range(60)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1.0).collect()
    small = whitening.whitened(spark.createDataFrame([(i, (np.array(v) - 2.0 ** 40).tolist()) for i, v in rows],
                                                     "vec_id long, embedding array<double>"), scale=1.0).collect()
    a, b = ({(r["vec_id"], r["component"]): (r["whitened"], r["deviation"]) for r in x} for x in (got, small))
    assert all(abs(a[k][0] - b[k][0]) < 1e-12 and a[k][1] == b[k][1] for k in b)


@pytest.mark.parametrize("width,rank", [(1, 1), (2, 2), (7, 7), (16, 9), (33, 33)])
def test_factor_and_rotations(width, rank):
    rng = np.random.default_rng(width)
    b = rng.normal(size=(width, rank))
    v = b @ b.T
    f = whitening.pivoted_cholesky(v)
    assert f.shape == (width, rank) and np.allclose(f @ f.T, v)
    e, u = whitening.one_sided_jacobi(f)
    assert np.allclose(u.T @ u, np.eye(rank), atol=1e-12) and np.allclose((u * e) @ u.T, v)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:rank])
    # a matrix with equal eigenvalues
    e, u = whitening.one_sided_jacobi(whitening.pivoted_cholesky(np.eye(width) * 3))
    assert np.allclose(e, 3) and np.allclose(u.T @ u, np.eye(width))


# ---------------------------------------------------------------------- 12

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(RANKS, bytebpe.class_table())


def same(codec, library, texts):
    ids, at, bound = codec.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        mine = ids[bound[i]:bound[i + 1]]
        assert mine.tolist() == library.encode_ordinary(t or ""), t
        assert codec.decode(mine).tobytes() == (t or "").encode()
        size = np.cumsum([0] + [len(library.decode_single_token_bytes(x)) for x in mine.tolist()])
        assert at[bound[i]:bound[i + 1]].tolist() == size[:-1].tolist()


def test_bpe_equals_the_library_on_contractions_and_white_space(codec, library):
    same(codec, library, ["don't you'll 've ''s 's's\t't \t's  's", None, "", " ", "  ", "a  b\n\n c \n", "\n", "'", "''", "'ll", "'l", "l'r",
                          "x'", "'s", " 'd x", "12'34 5", " '", "a　b  c  'S 'T", "\x1c \x85'm", "'", "s"])


def test_bpe_equals_the_library_on_random_texts(codec, library):
    rnd = random.Random(7)
    near = list("aastmdrvel' ''  \t\n01.,!é中 ́٣½\U0001d7d8\U0001f600\x1c\x00 ǅß")
    for size in (1, 2, 3, 7, 40, 700):
        same(codec, library, ["".join(rnd.choice(near) for _ in range(size)) for _ in range(60)])
    same(codec, library, ["".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(2000)) for _ in range(5)])


def test_bpe_of_long_slices_and_blocks_cut_anywhere(codec, library):
    same(codec, library, ["a" * 3000 + " " + "ab" * 900 + "!" * 999 + " " * 800 + "x" + "é" * 500, "中文" * 700, "'s" * bytebpe.BLOCK])
    for n in range(bytebpe.BLOCK - 3, bytebpe.BLOCK + 4):
        same(codec, library, ["x" * n + "'re you", " " * n + "'s", "a" * n, "!" * n + "'ve"])


def test_bpe_survives_a_shared_hash(codec, library, monkeypatch):
    own = bytebpe.Codec(RANKS, codec.classes)
    monkeypatch.setattr(bytebpe, "ranged", lambda v, a, b: (b - a).astype(np.uint64))  # slices of one length share their hash
    same(own, library, ["one two six ten", "abc def"])


def test_bpe_cache_starts_anew(codec, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE_PIECES", 8)
    own = bytebpe.Codec(RANKS, codec.classes)
    for t in ("one two three four five", "six seven eight nine ten", "one two three"):
        same(own, library, [t])


def test_bpe_frames_and_odd_rows(spark, library):
    rows = [(1, "Hello world, don't!"), (2, None), (3, ""), (None, "no id"), (4, "é中\x00 \x1c"), (4, "é中\x00 \x1c"), (5, "w x " * 300_000)]
    df = spark.createDataFrame([(i, t, "z", 9, "q", "r") for i, t in rows],
                               "doc_id long, text string, ids string, starts int, decoded string, bound string").repartition(3)
    got = Counter(tuple(r) for r in bytebpe.digests(df, RANKS).collect())
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    enc = bytebpe.encode(df.filter("doc_id = 1"), RANKS)
    r = bytebpe.decode(enc, RANKS).first()
    assert bytes(r["decoded"]).decode() == rows[0][1]
    assert np.frombuffer(bytes(r["starts"]), "<u4")[0] == 0 and enc.columns == ["doc_id", "ids", "starts"]
    assert bytebpe.digests(df.limit(0), RANKS).count() == 0
    with pytest.raises(Exception, match="positions"):
        bytebpe.decode(enc.withColumn("starts", F.lit(b"\x01\x00\x00\x00")), RANKS).collect()


def test_op12_equals_the_library(spark, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op12_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


# ---------------------------------------------------------------------- 13

def brute_collocations(rows, least, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        held = Counter()
        for g, a in c.items():
            if a >= least and len(g) > 2:
                for k in range(2, len(g)):
                    for i in range(len(g) - k + 1):
                        held[g[i:i + k]] = max(held[g[i:i + k]], a)
        mine = []
        for g, a in c.items():
            if a >= least and len(g) > 1 and 100 * held[g] < 80 * a:
                s, _, l, r = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                mine.append((-s, -a, " ".join(g).encode(), l, r))
        for k, (s, a, g, l, r) in enumerate(sorted(mine)[:top]):
            out.append((lang, k + 1, g.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def random_rows(n, seed, vocab="ab cd é x y zz"):
    rnd = random.Random(seed)
    words = vocab.split()
    return [(" ".join(rnd.choice(words) + rnd.choice(["", "", "", "", ",", ".", "\n", "\t"]) for _ in range(rnd.randrange(40))),
             rnd.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"hot": 40, "bucket_windows": 100}, {"hot": 5, "dictionary": 3}, {"dictionary": 0}])
def test_collocations_match_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_WINDOWS", 200)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 30)
    repeat = "the long passage that is said again and again in quite many texts"
    rows = random_rows(80, 1) + [("A b. A b; a B c d e", "en"), (None, "en"), ("", None), (" \t ", "und"), (repeat + ". x", "en"), (repeat, "en"), ("x " + repeat, "en")] * 3
    df = spark.createDataFrame([(t, g, 1, "s") for t, g in rows], "text string, lang string, gram int, c1 string").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=3, **options).collect())
    assert got == brute_collocations(rows, 3)


def test_collocations_of_runs_long_texts_and_nothing(spark):
    rows = [("ha " * 50, "en"), ("ha " * 3 + ". ha ho", "en"), ("w " * 70_000, "fr"), ("x y z " * 9, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in phrases.collocations(df, least=5).collect()) == brute_collocations(rows, 5)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


def test_ties_are_ordered_and_cut(spark):
    rows = [(f"{a}x {a}y", "en") for a in "ébAzc" for _ in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = [tuple(r) for r in phrases.collocations(df, least=3, top=3).orderBy("rank").collect()]
    assert got == brute_collocations(rows, 3, 3) and len(got) == 3


def test_paths_join_edges_of_equal_flow(spark):
    # one phrase of eight words, twice with a branch before its last word
    g = [[1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5, 6], [4, 5, 6, 7], [4, 5, 6, 8]]
    f = [9, 9, 9, 5, 4]
    nodes = [([1, 2, 3], 9), ([2, 3, 4], 9), ([3, 4, 5], 9), ([4, 5, 6], 9), ([5, 6, 7], 5)]
    grams = spark.createDataFrame([*zip(g, f), *nodes], "gram array<long>, f long")
    got = {tuple(r["gram"]): (tuple(r["head"]), r["place"]) for r in phrases.paths(grams).collect()}
    assert got == {(1, 2, 3, 4): ((1, 2, 3, 4), 0), (2, 3, 4, 5): ((1, 2, 3, 4), 1), (3, 4, 5, 6): ((1, 2, 3, 4), 2),
                   (4, 5, 6, 7): ((4, 5, 6, 7), 0), (4, 5, 6, 8): ((4, 5, 6, 8), 0)}


def test_node_flow_counts_piece_ends():
    code = np.array([1, 2, 3, 1, 2, 3, 4, 5], np.uint64)
    first = np.array([1, 0, 0, 1, 0, 0, 0, 1], bool)
    w, n = phrases._counted(phrases.windows(code, first), np.ones(8, np.int64))
    got = phrases.node_flow(w, n, 0, 1)
    f = {tuple(int(got[c][i]) for c in ("c1", "c2", "c3", "c4") if got[c][i]): int(got["f"][i]) for i in range(len(got["f"]))}
    assert f == {(1,): 2, (2,): 2, (3,): 2, (4,): 1, (5,): 1, (1, 2): 2, (2, 3): 2, (3, 4): 1, (1, 2, 3): 2, (2, 3, 4): 1, (1, 2, 3, 4): 1}
