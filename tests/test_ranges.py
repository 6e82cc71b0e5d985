"""Reading CSV in byte ranges that cut anywhere."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tessel.sources import ranges, readers


def write(path, rows, header=("id", "a", "b")):
    buf = io.StringIO(newline="")
    w = csv.writer(buf, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(buf.getvalue().encode())


def read(spark, path, size):
    with ranges.split_bytes(spark, size):
        df = ranges.read_csv_ranges(spark, str(path), ["id", "a", "b"])
        return sorted(map(tuple, df.collect())), df.rdd.getNumPartitions()


ODD = ["plain", 'say ""x"" "', "two\nlines", "\n\n", 'q"\n"q', "é中\U0001f600" * 3, "a,b", "", "NA", "x\ry", "long " * 30 + "\n" + 'tail"' * 9, ' "half', "a\n\"\"\nb"]


@pytest.mark.parametrize("size", [7, 16, 33, 64, 257, 100_000])
def test_ranges_may_cut_fields_quotes_and_characters(spark, tmp_path, size):
    rnd = random.Random(size)
    rows = [(str(i), rnd.choice(ODD), rnd.choice(ODD)) for i in range(60)]
    write(tmp_path / "p.csv", rows)
    want = sorted((i, *(None if x in ("", "NA") else x for x in (a, b))) for i, a, b in rows)
    got, parts = read(spark, tmp_path / "p.csv", size)
    key = lambda r: tuple((x is None, x or "") for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert parts >= (8 if size < 1000 else 1)
    whole = sorted(map(tuple, readers.csv_by_name(spark, str(tmp_path / "p.csv"), ["id", "a", "b"]).collect()), key=key)
    assert whole == sorted(want, key=key)


def test_many_files_headers_and_columns_by_name(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"{k}.csv", [(f"x{k}", f"{k}{i}\nz", "b") for i in range(20)], header=("b", "id", "a"))
    got, _ = read(spark, tmp_path, 40)
    assert got == sorted((f"{k}{i}\nz", "b", f"x{k}") for k in range(3) for i in range(20))
    with pytest.raises(ValueError, match="no column z"):
        ranges.read_csv_ranges(spark, str(tmp_path), ["z"])


def test_header_over_several_ranges(spark, tmp_path):
    name = "a\nvery\nlong\nheader " * 5
    write(tmp_path / "h.csv", [("1", "x", "y"), ("2", "x\n", "z")], header=("id", name, "b"))
    with ranges.split_bytes(spark, 16):
        got = sorted(map(tuple, ranges.read_csv_ranges(spark, str(tmp_path / "h.csv"), ["id", name, "b"]).collect()))
    assert got == [("1", "x", "y"), ("2", "x\n", "z")]


def test_a_row_over_many_ranges_and_an_open_quote(spark, tmp_path):
    write(tmp_path / "l.csv", [("1", "w\n" * 500, "y"), ("2", "x", "z")])
    got, parts = read(spark, tmp_path / "l.csv", 50)
    assert got == [("1", "w\n" * 500, "y"), ("2", "x", "z")] and parts > 10
    (tmp_path / "o.csv").write_text('id,a,b\n1,x,"y\n2,x,y\n' * 1 + "3,x,y\n" * 20)
    got, _ = read(spark, tmp_path / "o.csv", 30)
    assert len(got) == 1 and got[0][0] == "1" and got[0][2].count("\n") >= 21


def test_empty_file_and_empty_lines(spark, tmp_path):
    write(tmp_path / "e.csv", [])
    assert read(spark, tmp_path / "e.csv", 20)[0] == []
    (tmp_path / "b.csv").write_text("id,a,b\n\n1,x,y\n\n\n2,x,y\n\n")
    assert read(spark, tmp_path / "b.csv", 5)[0] == [("1", "x", "y"), ("2", "x", "y")]


@pytest.mark.parametrize("line,out,ins", [("a,b", False, True), ('a,"b', True, False), ('"a","b"', False, False), ('5" pipe,x', False, False),
                                          ('x",y', False, False), ('""', False, True), ('"""', True, False), ('a""', False, True), ('","', False, True)])
def test_states_of_a_line(line, out, ins):
    assert ranges.inside_after(line, False) is out
    assert ranges.inside_after(line, True) is ins


def test_states_compose_like_the_whole_text():
    rnd = random.Random(3)
    lines = ["".join(rnd.choice('ab,"') for _ in range(rnd.randrange(6))) for _ in range(400)]
    inside, opened, truth = False, 0, []
    for k, line in enumerate(lines):
        truth.append((inside, opened if inside else 0))
        if not inside:
            opened = k // 10 * 10
        inside = ranges.inside_after(line, inside)
    found = []
    for k in range(0, 400, 10):
        out, ins, closes = False, True, False
        for line in lines[k:k + 10]:
            out, ins = ranges.inside_after(line, out), ranges.inside_after(line, ins)
            closes |= not ins
        found.append(("f", k, out, ins, closes))
    states = ranges.States(found)
    assert [states.at("f", k) for k in range(0, 400, 10)] == [truth[k] for k in range(0, 400, 10)]
    assert states.at("g", 5) == (False, 0)


def test_size_is_known_so_ranges_are_few(spark, tmp_path):
    """The size of written posts places the ranges: without it, every file was cut at 16 KB."""
    from tessel.plans import q_sources
    from tessel.session import size_estimate
    (tmp_path / "t").write_bytes(b"x" * 5000)
    assert size_estimate(spark.read.text(str(tmp_path / "t"))) == 5000
    texts = [(i, "word " * 4000, "en", "web") for i in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = q_sources.read_posts_ranges(spark, str(tmp_path))
    assert got.count() == 400
    assert got.rdd.getNumPartitions() <= 4 * q_sources.RANGES
