"""Token-id files: flat unsigned integers plus 64-bit document offsets.

Layout below a folder (any file system pyarrow can open, memory-mapped where it
is a mounted one):

``<name>.bin``  the token ids of consecutive documents, little-endian uint16
                when the vocabulary fits, else uint32, nothing between them
``<name>.idx``  little-endian int64: the start of every document in the ``.bin``
                file, then its end
``<name>.doc``  little-endian int64: the document ids (a null id: the smallest int64)
``manifest``    Parquet, one row per file: ``part, name, n_docs, n_tokens, width,
                base``; ``base`` = ids in all earlier files (prefix sum), so a document's
                global position is ``base`` + its ``.idx`` entry

Documents stand in ascending id order across the files. A task writes files
named after its attempt and returns their names; only files named in the
manifest belong to the data set, so a lost or repeated task leaves a stray file,
never a wrong one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .store import bounded_batches
from .words import slices

NULL_ID = -(1 << 63)
READ_TOKENS = 4 << 20  # ids a reader task looks at before it emits rows


def _open(uri: str):
    from pyarrow import fs
    if "://" not in uri and ":/" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":/", ":///", 1))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write the files; returns the manifest.

    Rows sharing an id stand in text order; a null text has the end id only; an
    empty table gives an empty manifest. One shuffle (range by id) moves the
    texts; ids never move.
    """
    spark = docs.sparkSession
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)
    ordered = (bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange("id").sortWithinPartitions("id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode = tokens.encoder(tokenizer)
        name, n_docs, n_tokens, width, out = f"{part:06d}-{uuid.uuid4().hex}", 0, 0, 2, None
        fs, root = _open(path)
        for b in slices(batches):
            ids, off = encode(b.column("text"))
            if out is None:
                width = max(ids.dtype.itemsize, 4 if end_id > 0xFFFF else 2)
                out = [fs.open_output_stream(f"{root}/{name}.{kind}") for kind in ("bin", "idx", "doc")]
            flat = np.insert(ids.astype(f"<u{width}"), off[1:], end_id)
            own = off + np.arange(len(off))
            out[0].write(flat.tobytes())
            out[1].write((n_tokens + own[:-1]).astype("<i8").tobytes())
            out[2].write(b.column("id").fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
            n_docs, n_tokens = n_docs + b.num_rows, n_tokens + len(flat)
        if out:
            out[1].write(np.array([n_tokens], "<i8").tobytes())
            for f in out:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [n_docs],
                                              "n_tokens": [n_tokens], "width": [width]}, schema=schema)

    schema = pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("width", pa.int64())])
    files = ordered.mapInArrow(write, "part long, name string, n_docs long, n_tokens long, width long").checkpoint()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))) \
        .coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _mapped(uri: str, dtype: str) -> np.ndarray:
    from pyarrow import fs as pafs
    fs, p = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        import os
        return np.memmap(p, dtype, "r") if os.path.getsize(p) else np.zeros(0, dtype)
    return np.frombuffer(fs.open_input_file(p).read_buffer(), dtype)


def open_part(path: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory-mapped ids, document offsets and document ids of one file."""
    return (_mapped(f"{path}/{name}.bin", f"<u{width}"), _mapped(f"{path}/{name}.idx", "<i8"),
            _mapped(f"{path}/{name}.doc", "<i8"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it; the checksum is over the
    ids as little-endian uint32."""
    manifest = spark.read.parquet(f"{path}/manifest")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, off, doc = open_part(path, row["name"], row["width"])
                i, n = 0, len(doc)
                while i < n:
                    j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + READ_TOKENS, "right")) - 1))
                    crc = [zlib.crc32(ids[off[k]:off[k + 1]].astype("<u4").tobytes()) for k in range(i, j)]
                    own = doc[i:j]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own, pa.int64(), mask=np.asarray(own == NULL_ID)),
                        pa.array(row["base"] + off[i:j]), pa.array(np.diff(off[i:j + 1])), pa.array(crc, pa.int64())], schema=schema)
                    i = j

    # a file a task: the manifest has one row per file
    return (manifest.repartition(max(1, manifest.count()))
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
