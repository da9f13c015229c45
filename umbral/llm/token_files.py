"""Token ids of a whole table in files of independent zstandard frames, in ascending order of the key.

Writing: one range shuffle puts the texts in order (key, then row number, so that equal keys do not have to meet in one task); every task encodes
its range and streams it into one file of the shared folder (``frames.py`` has the layout). What a task returns is the line of its file in the
manifest. File names are new for each attempt of a task and only the manifest names files, so a lost or repeated task leaves at most a file nobody reads.

Reading: all documents (a task for each file), or only requested keys: the tables at the ends of the files say where they lie, and only their frames
are decompressed. How many ids lie before a file comes from the manifest, which has a line for each file and is the one thing the driver sees.

Defined cases: a missing text is an empty one; an empty text is the end id alone; rows without a key come last; rows that
repeat a key, or everything, are documents of their own, side by side; an empty table gives no files and no rows; other columns are not read. Keys are whole numbers
of up to 64 bits. Folders are those ``pyarrow.fs`` can open by their address on every executor (a shared local path, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbral.llm.frames import FrameReader, FrameWriter
from umbral.llm.text import gathered
from umbral.llm.word_ids import encoder

MANIFEST = "file int, path string, n_docs bigint, n_ids bigint, least bigint, greatest bigint, no_key bigint"


@dataclass(frozen=True)
class TokenFiles:
    """``tokenizer`` is the file of a vocabulary with word ends; ``width`` bytes hold an id."""

    tokenizer: str
    end_id: int = 2
    width: int = 2
    frame_ids: int = 1 << 15
    level: int = 3
    batch_bytes: int = 1 << 22


def public_token_files(name: str = "word_bpe_49k", **options) -> TokenFiles:
    """The settings for one of the installed public vocabularies."""
    import public_tokenizers

    return TokenFiles(public_tokenizers.path(f"{name}.json"), **options)


def encoded(batches: Iterator[pa.RecordBatch], how: TokenFiles) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(key, ids with the end id)`` of each row."""
    for batch in gathered(batches, how.batch_bytes):
        ids, edges = encoder(how.tokenizer).encode(batch.column(1))
        for k, key in enumerate(batch.column(0).to_pylist()):
            yield key, np.append(ids[edges[k] : edges[k + 1]], np.uint32(how.end_id))


def write_token_files(df: DataFrame, folder: str, how: TokenFiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``df``'s texts below ``folder``; returns the manifest, which is stored there as well.

    Rows of the manifest: ``file`` (files in this order hold ascending keys), ``path``, documents, ids, least and greatest key, documents without one.
    """
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = encoded(batches, how)
        first = next(rows, None)
        if first is None:
            return
        system, base = fs.FileSystem.from_uri(folder)
        number = TaskContext.get().partitionId()
        name = f"ids-{number:06d}-{uuid.uuid4().hex}.zst"
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            writer = FrameWriter(out, how.width, how.frame_ids, how.level)
            writer.add(*first)
            for one in rows:
                writer.add(*one)
            writer.close()
        keys = [k for k in writer.keys if k is not None]
        line = (number, f"{folder}/{name}", len(writer.keys), sum(writer.sizes), min(keys, default=None), max(keys, default=None), len(writer.keys) - len(keys))
        kinds = (pa.int32(), pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(line, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    numbered = df.select(F.col(key).cast("bigint").alias("__key"), F.col(text).cast("string").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    order = [F.col("__key").asc_nulls_last(), F.col("__row")]
    placed = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("__key", "__text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def files_with_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, before)``, a task for each: the files and how many ids lie before them."""
    lines = manifest(spark, folder).select("file", "path", "n_ids").orderBy("file").toArrow().to_pandas()
    before = np.r_[0, np.cumsum(lines["n_ids"].to_numpy(np.int64))][:-1]
    rows = list(zip(lines["path"].tolist(), before.tolist(), strict=True))
    return spark.createDataFrame(rows, "path string, before bigint").repartition(max(1, len(rows)))


def _open(path: str) -> FrameReader:
    system, where = fs.FileSystem.from_uri(path)
    return FrameReader(system.open_input_file(where))


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``; ``with_ids`` adds the ids."""
    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _in_batches(((k, before + at, ids) for k, at, ids in _open(path)), key, with_ids)

    return files_with_starts(spark, folder).mapInArrow(run, schema)


def _in_batches(documents: Iterator[tuple], key: str, with_ids: bool, most_rows: int = 4096, most_ids: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        keys, starts, ids = zip(*rows, strict=True)
        arrays = [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
        if with_ids:
            arrays.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    for one in documents:
        rows.append(one)
        size += len(one[2])
        if len(rows) >= most_rows or size >= most_ids:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def places(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, path, place, before)`` of every document, from the tables at the ends of the files; no frame is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs = _open(path).documents
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs["key"].astype(np.int64), mask=docs["has_key"] == 0), pa.array([path] * n), pa.array(np.arange(n)), pa.array(np.full(n, before))],
                    names=["key", "path", "place", "before"],
                )

    return files_with_starts(spark, folder).mapInArrow(run, "key bigint, path string, place bigint, before bigint")


def read_requested(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key is in ``wanted`` (a missing key asks for those without one), with their ids, as ``read_token_files`` gives them.

    A file's requested documents are read one after another, so each of their frames is decompressed once and no other frame is touched.
    """
    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents():
            at, reader = None, None
            for batch in batches:
                for path, place, before in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    if path != at:
                        at, reader = path, _open(path)
                    yield reader.key(place), before + int(reader.starts[place]), reader.ids(place)

        yield from _in_batches(documents(), key, True)

    asked = wanted.select(F.col(key).cast("bigint").alias("asked")).distinct()
    found = places(spark, folder).join(asked, F.col("key").eqNullSafe(F.col("asked")), "left_semi")
    return found.select("path", "place", "before").repartition("path").sortWithinPartitions("path", "place").mapInArrow(run, schema)
