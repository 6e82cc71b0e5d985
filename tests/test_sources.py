"""Readers and writers: CSV edge cases, counts JSON, partition pruning, images."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessel.sources import readers, writers


def tmpdir():
    return tempfile.mkdtemp(prefix="tessel-test-", dir="/tmp")


def test_read_posts_csv_edge_cases(spark):
    d = tmpdir()
    p = os.path.join(d, "posts.csv")
    with open(p, "w", newline="") as f:
        f.write('id,headline,related_text,original_img_dir,original_img_filename\n')
        f.write('1,"say ""hi"" now","line one\nline two",dir/,a.b.jpg\n')
        f.write('2,NA,"with\rcarriage",,\n')
        f.write('3,nan,None," null ",x\n')
    rows = {r.id: r for r in readers.read_posts(spark, p).collect()}
    assert rows["1"].headline == 'say "hi" now'
    assert rows["1"].related_text == "line one\nline two"
    assert rows["2"].headline is None and rows["2"].related_text == "with\rcarriage"
    assert rows["2"].original_img_dir is None
    assert rows["3"].headline is None and rows["3"].related_text is None
    assert rows["3"].original_img_dir == " null "


def test_write_counts_one_json_object(spark):
    d = tmpdir()
    counts = spark.createDataFrame([("en", 3), ("de", 1)], "lang string, n long")
    writers.write_counts(counts, d + "/counts")
    text = "".join(open(os.path.join(d, "counts", f)).read() for f in os.listdir(d + "/counts") if f.startswith("part"))
    assert json.loads(text) == {"de": 1, "en": 3}


def test_clean_csv_round_trip(spark):
    d = tmpdir()
    df = spark.createDataFrame([("u1", 'quote " and, comma', "dir/", "f"), ("u2", "new\nline", None, "g")],
                               "uid string, text string, img_dir string, img_fname string")
    writers.write_clean(df, d + "/clean", fmt="csv")
    back = {r.uid: r for r in readers.read_clean(spark, d + "/clean", fmt="csv").collect()}
    assert back["u1"].text == 'quote " and, comma' and back["u2"].text == "new\nline"
    assert back["u2"].img_dir is None


def test_read_pairs_prunes_splits(spark):
    d = tmpdir()
    df = spark.createDataFrame([(i, f"p{i}", f"h{i}", i % 3, s) for i, s in enumerate(["train", "test_lay"] * 5)],
                               "pair_id long, premise string, hypothesis string, label int, split string")
    df.write.partitionBy("split").parquet(d + "/pairs")
    got = readers.read_pairs(spark, d + "/pairs", ["test_lay"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and got.count() == 5


def test_map_csv_and_vector_round_trip(spark):
    d = tmpdir()
    df = spark.createDataFrame([("a", "t a", [1.0, 0.5]), ("b", "t b", [0.123456, 1e-7])],
                               "uid string, text string, vec array<double>")
    writers.write_map(df, d + "/map", fmt="csv")
    back = {r.uid: r.vec for r in readers.read_map_csv(spark, d + "/map").collect()}
    assert back == {"a": [1.0, 0.5], "b": [0.123456, 1e-7]}


def test_map_csv_as_it_is_exported(spark):
    d = tmpdir()
    with open(d + "/map.csv", "w") as f:
        f.write(",uid,text,img_dir,img_fname,vec\n0,a,NA,d/,f,[1.  5e-8]\n1,b,t b,,g,[1. 2. 3.]\n2,c,\"x, y\",d/,h,\"[0.5\n 0.25]\"\n")
    back = {r.uid: (r.text, r.vec) for r in readers.read_map_csv(spark, d + "/map.csv").collect()}
    assert back == {"a": (None, [1.0, 5e-8]), "c": ("x, y", [0.5, 0.25])}


def test_columns_go_by_name(spark):
    d = tmpdir()
    with open(d + "/posts.csv", "w") as f:
        f.write("id,created,related_text,headline,extra,original_img_filename,original_img_dir\n1,2021,REL,HEAD,x,f.jpg,dir/\n")
    r = readers.read_posts(spark, d + "/posts.csv").first()
    assert (r.id, r.headline, r.related_text, r.original_img_dir, r.original_img_filename) == ("1", "HEAD", "REL", "dir/", "f.jpg")
    with open(d + "/clean.csv", "w") as f:
        f.write("text,uid,img_fname,img_dir\nhello,u1,NA,d\n")
    assert tuple(readers.read_clean(spark, d + "/clean.csv", fmt="csv").first()) == ("u1", "hello", "d", None)
    with open(d + "/short.csv", "w") as f:
        f.write("id,headline\n1,x\n")
    with pytest.raises(ValueError, match="related_text"):
        readers.read_posts(spark, d + "/short.csv")


def test_images_of_the_clean_table(spark):
    """From raw posts to joint vectors: relative paths without extension find their file."""
    from tessel.functions import text as T
    from tessel.operators import encode as enc
    from tessel.operators import text as ops
    d = tmpdir()
    os.makedirs(d + "/img/original_images/s")
    for name in ("f1.jpg", "f1.png", "f3.v2.jpg"):
        with open(f"{d}/img/original_images/s/{name}", "wb") as f:
            f.write(name.encode() * 9)
    posts = spark.createDataFrame([(str(i), "one two three four five six", None, "original_images/s/", f"f{i}.jpg", "en") for i in (1, 2)]
                                  + [("3", "one two three four five six", None, "original_images/s/", "f3.v2.jpg", "en")],
                                  "id string, headline string, related_text string, original_img_dir string, original_img_filename string, lang string")
    clean = ops.clean_posts(posts)
    caps = clean.select("uid", T.image_path("img_dir", "img_fname").alias("img_fpath"), F.col("text").alias("caption"))
    out = {r.uid: r for r in readers.attach_images(caps, d + "/img").collect()}
    assert {u: r.has_image for u, r in out.items()} == {"1": True, "2": False, "3": True}
    assert bytes(out["1"].content) == b"f1.jpg" * 9 and bytes(out["3"].content) == b"f3.v2.jpg" * 9 and out["2"].content is None
    joint = enc.embed_pairs(readers.attach_images(caps, "file://" + d + "/img"), "content", "caption").collect()
    assert len(joint) == 3 and all(len(r.joint) == 128 for r in joint)
    absolute = spark.createDataFrame([("u", f"file:{d}/img/original_images/s/f1.png")], "uid string, img_fpath string")
    assert readers.attach_images(absolute, d + "/img").first().has_image


def test_write_predictions_and_metrics(spark):
    d = tmpdir()
    df = spark.createDataFrame([("test_lay", "p", "h", 0.9, 2), ("test_lay", "q", "h", 0.1, 0),
                                ("test_expert", "r", "h", 0.5, 1)],
                               "split string, premise string, hypothesis string, pred double, label int")
    writers.write_predictions(df, d + "/pred")
    back = readers.read_predictions(spark, d + "/pred")
    assert back.columns[:4] == ["premise", "hypothesis", "pred", "label"] and back.count() == 3
    assert readers.read_predictions(spark, d + "/pred", ["test_expert"]).count() == 1
    m = spark.createDataFrame([("m1", "test_lay", 0.5)], "model string, split string, f1 double")
    writers.write_metrics(m, d + "/metrics")
    assert spark.read.json(d + "/metrics").count() == 1


def test_vectors_sets_report_round_trip(spark):
    d = tmpdir()
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.25])], "uid string, vec array<float>")
    writers.write_vectors(v, d + "/vec")
    back = {r.uid: r.vec for r in readers.read_vectors(spark, d + "/vec").collect()}
    assert back == {"a": [1.0, 2.0], "b": [0.5, 0.25]}
    sets = spark.createDataFrame([(0, 1, "u2", "t2", 0), (0, 0, "u1", "t1", 0)],
                                 "index int, pos int, uid string, text string, label int")
    writers.write_sets(sets, d + "/sets")
    assert spark.read.json(d + "/sets").count() == 2
    rep = spark.createDataFrame([(7, "x\ny")], "q_uid long, report string")
    writers.write_report(rep, d + "/rep")
    lines = [r.value for r in spark.read.text(d + "/rep").collect()]
    assert lines[0] == "indexes 7" and lines[1:3] == ["x", "y"]


def test_splits_are_written_one_by_one(spark):
    d = tmpdir() + "/tables"
    schema = "split string, premise string, hypothesis string, pred double, label int, pair_id long"
    lay = spark.createDataFrame([("test_lay", " p ", "h\nh", 0.9, 2, 1), ("test_lay", "q", None, 0.9, 0, 2)], schema)
    expert = spark.createDataFrame([("test_expert", "r", "h", 0.5, 1, 3)], schema)
    assert writers.write_predictions(lay, d) == ["test_lay"]
    assert writers.write_predictions(expert, d) == ["test_expert"]
    rows = sorted((r.split, r.premise, r.hypothesis, r.label) for r in readers.read_predictions(spark, d).collect())
    assert rows == [("test_expert", "r", "h", 1), ("test_lay", " p ", "h\nh", 2), ("test_lay", "q", None, 0)]
    writers.write_predictions(lay.filter("label = 2"), d)
    assert writers.write_predictions(lay.limit(0), d) == []
    assert sorted((r.split, r.premise) for r in readers.read_predictions(spark, d).collect()) == [("test_expert", "r"), ("test_lay", " p ")]
    assert {r.split: r.rows for r in writers.written_splits(spark, d).collect()} == {"test_lay": 1, "test_expert": 1}
    assert spark.read.json(writers.manifest_path(d)).count() == 3
