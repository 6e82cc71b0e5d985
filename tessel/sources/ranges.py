"""S1 in parallel: CSV with quoted line breaks, read in byte ranges of its files.

Spark's line scan cuts files into ranges on any file system; what it cannot know is
whether a range starts inside a quoted field. A line is a function on the state
``inside a quoted field or not``, and such functions compose: a first pass over the lines
that hold a quote reports, for each range and both states it may start in, the state at its end. Combined
in file order they fix every range's state. The second pass puts lines together into
rows; a row that runs over the end of a range comes out in fragments, which are joined by
the range it started in. Fields are taken apart by Spark's own CSV expression.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import na_to_null

ROW, HEAD, TAIL, HEADER = range(4)  # a whole row; the end or middle of one from an earlier range; the start of one that goes on; a file's first
_REST = re.compile(r'(?:[^"]+|"")*+"([^,]*)(?:,|\Z)', re.S)       # from inside a quoted field to behind it
_FIELD = re.compile(r'"(?:[^"]+|"")*+"[^,]*(?:,|\Z)|[^",][^,]*(?:,|\Z)|,', re.S)  # a whole field; a quote inside a bare field is text


def inside_after(line: str, inside: bool) -> bool:
    """Whether the end of the line is inside a quoted field."""
    at = 0
    if inside:
        m = _REST.match(line)
        if not m:
            return True
        at = m.end()
    while at < len(line):
        m = _FIELD.match(line, at)
        if not m:
            return True  # a quote opens a field that the line does not close
        at = m.end()
    return False


class States:
    """State at the start of any range of any file, and the range in which the row open there started."""

    def __init__(self, ranges: list[tuple[str, int, bool, bool, bool]]):
        """``file, start, inside at the end if started outside, if started inside, whether a row ends if started inside``."""
        self.files: dict[str, tuple[list[int], list[tuple[bool, int]]]] = {}
        for file, start, out, ins, closes in sorted(ranges):
            starts, after = self.files.setdefault(file, ([], []))
            inside, opened = after[-1] if after else (False, 0)
            end = ins if inside else out
            after.append((end, (start if not inside or closes else opened) if end else 0))
            starts.append(start)

    def at(self, file: str, start: int) -> tuple[bool, int]:
        starts, after = self.files.get(file, ((), ()))
        k = bisect_left(starts, start)
        return after[k - 1] if k else (False, 0)


@contextmanager
def split_bytes(spark: SparkSession, size: int):
    """Ranges of about ``size`` bytes for what is executed inside."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], str(max(1, size // 8)))
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The runs of one range in a batch."""
    file, start, value = batch.columns
    a = 0
    while a < batch.num_rows:
        f, s = file[a], start[a]
        same = pc.and_(pc.equal(file[a:], f), pc.equal(start[a:], s))
        n = pc.index(same, False).as_py()
        b = batch.num_rows if n < 0 else a + n
        yield f.as_py(), s.as_py(), value[a:b]
        a = b


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, start, value in _blocks(batch):
            s = found.setdefault((file, start), [False, True, False])
            for line in value.to_pylist():
                s[0], s[1] = inside_after(line, s[0]), inside_after(line, s[1])
                s[2] |= not s[1]
    if found:
        yield pa.RecordBatch.from_pydict({
            "file": [k[0] for k in found], "start": pa.array([k[1] for k in found], pa.int64()),
            "outside": [v[0] for v in found.values()], "inside": [v[1] for v in found.values()], "closes": [v[2] for v in found.values()]})


def range_states(lines: DataFrame) -> States:
    """One small row per range that holds a quote reaches the driver: as many as there are ranges, whatever their size."""
    quoted = lines.filter(F.contains("value", F.lit('"')))  # any other line leaves the state as it is
    return States([tuple(r) for r in quoted.mapInArrow(_scan, "file string, start long, outside boolean, inside boolean, closes boolean").collect()])


class _Assembler:
    """Puts the lines of one range after another together into rows and fragments."""

    def __init__(self, states: States):
        self.states, self.at, self.kept = states, None, []
        self.out: list[tuple[str, int, int, int, str]] = []

    def start(self, file: str, start: int) -> None:
        self.finish()
        self.at = (file, start)
        self.inside, self.opened = self.states.at(file, start)
        self.kind = HEAD if self.inside else HEADER if start == 0 else ROW
        if not self.inside:
            self.opened = start

    def add(self, line: str, quoted: bool) -> None:
        self.kept.append(line)
        if quoted:
            self.inside = inside_after(line, self.inside)
        if not self.inside:
            text = self.kept[0] if len(self.kept) == 1 else "\n".join(self.kept)
            if self.kind == HEAD or self.kind == ROW and text:  # empty lines are no rows, the header is left out
                self.out.append((self.at[0], self.opened, self.kind, self.at[1], text))
            self.kept, self.kind, self.opened = [], ROW, self.at[1]

    def finish(self) -> None:
        """The range ends; what is kept goes on in the next one."""
        if self.kept:
            self.out.append((self.at[0], self.opened, TAIL if self.kind == ROW else self.kind, self.at[1], "\n".join(self.kept)))
            self.kept = []

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
        columns = zip(*self.out) if self.out else ([],) * 5
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "opened", "kind", "start", "value"])
        self.out = []
        return b


def rows_of(lines: DataFrame, states: States) -> DataFrame:
    """``value``: whole CSV rows, without empty lines and the rows with which files start (headers)."""
    shared = lines.sparkSession.sparkContext.broadcast(states)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Assembler(shared.value)
        for batch in batches:
            for file, start, value in _blocks(batch):
                if (file, start) != rows.at:
                    rows.start(file, start)
                for line, quoted in zip(value.to_pylist(), pc.match_substring(value, '"').to_pylist()):
                    rows.add(line, quoted)
            yield rows.batch()
        rows.finish()
        yield rows.batch()

    pieces = lines.mapInArrow(assemble, "file string, opened long, kind int, start long, value string")
    # at most two fragments a range; the many whole rows pass by without a shuffle
    joined = (pieces.filter(F.col("kind") != ROW).groupBy("file", "opened")
              .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("f"))
              .filter(~F.exists("f", lambda x: x["kind"] == HEADER))
              .select(F.array_join(F.transform("f", lambda x: x["value"]), "\n").alias("value")))
    return pieces.filter(F.col("kind") == ROW).select("value").unionByName(joined)


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path).columns


def read_csv_ranges(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named string columns of CSV files with equal headers, like ``readers.csv_by_name`` (quoted fields may span
    lines, quotes are doubled, rows end in '\\n', NA words become NULL), with one task per byte range instead of per file.

    Ranges are those of the session (``spark.sql.files.maxPartitionBytes``) when this is called, and must be the same when the frame
    runs: the states belong to them. A row longer than a range is joined from its fragments; an open quote makes the rest of
    its file one row. A range's rows do not depend on the others, so a lost task is read again alone.
    """
    names = header(spark, path)
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header ({', '.join(names)})")
    lines = _lines(spark, path)
    whole = rows_of(lines, range_states(lines))
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    options = {"quote": '"', "escape": '"', "emptyValue": "", "lineSep": "\n", "multiLine": "true", "mode": "PERMISSIVE"}
    fields = whole.select(F.from_csv("value", schema, options).alias("r"))
    return na_to_null(fields.select(*[F.col(f"r.c{names.index(c)}").alias(c) for c in columns]))
