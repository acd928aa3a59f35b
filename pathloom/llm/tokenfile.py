"""Token-id files: documents encoded, range-coded in frames, written, and read back.

A token file is a folder of records (part, frame, first, n_docs, n_tokens, payload) in
ascending key order; ``payload`` is a frame of :mod:`coder`, and ``first`` counts the ids of
its part before it. Frames hold whole documents, about FRAME ids, and decode alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coder
from .common import shared_folder, shuffle_partitions, slices
from .tokens import BLOCK_BYTES, default_path, encoder

#: A frame is closed once it has so many ids (1024 blocks).
FRAME = 1 << 22

_RECORD = "part int, frame int, first long, n_docs long, n_tokens long, payload binary"


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Records of all documents in ascending doc_id (nulls first; equal ids by text)."""
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        frame, first, held, lengths, held_ids, keys = 0, 0, [], [], 0, []

        def close() -> pa.RecordBatch:
            payload = coder.encode(np.concatenate(held), np.concatenate(lengths), keys)
            values = ([part], [frame], [first], [len(keys)], [held_ids], [payload])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "frame", "first", "n_docs", "n_tokens", "payload"]
            )

        for batch in slices(batches, most=BLOCK_BYTES):
            ids, at = encode(batch.column("text"))
            held.append(ids)
            lengths.append(np.diff(at))
            keys += batch.column("doc_id").to_pylist()
            held_ids += len(ids)
            if held_ids >= FRAME:
                yield close()
                frame, first, held, lengths, held_ids, keys = frame + 1, first + held_ids, [], [], 0, []
        if held:
            yield close()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = docs.repartitionByRange(shuffle_partitions(documents.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return ranged.mapInArrow(run, _RECORD)


def write(documents: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Writes the documents' token file to a folder that all executors share."""
    encode_documents(documents, vocabulary).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token file: doc_id, start, n_tokens, ids_crc32, ids (array).

    ``start`` counts the ids of all documents before. Only one count per part, of which there
    are as many as write partitions, is gathered.
    """
    records = spark.read.schema(_RECORD).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in records.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offset, before = {}, 0
    for part, n in totals:
        offset[part] = before
        before += n
    shared = spark.sparkContext.broadcast(offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths, keys = coder.decode(batch.column("payload")[k].as_py())
                ends = np.cumsum(lengths)
                start = shared.value[batch.column("part")[k].as_py()] + batch.column("first")[k].as_py() + ends - lengths
                body = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                # a frame's documents leave in a few batches, so that their ids are not copied at once
                edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(1 << 19, int(ends[-1]) if len(ends) else 0, 1 << 19)), [len(ends)]]))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    low = int(ends[a] - lengths[a])
                    own = pa.array(ids[low : int(ends[b - 1])].astype(np.int64))
                    places = pa.array(np.concatenate([[low], ends[a:b]]) - low, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[a:b], pa.int64()), pa.array(start[a:b]), pa.array(lengths[a:b]),
                            pa.array(crcs[a:b], pa.int64()), pa.ListArray.from_arrays(places, own),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return records.select("part", "first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def round_trip(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the documents to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id alone; null ids and repeated rows are kept; an empty
    table gives an empty result; other columns, whatever their names, are ignored. A very long text
    makes its frame as long as itself. The file stays for later readers.
    """
    spark = documents.sparkSession
    path = f"{shared_folder(spark)}/token-file-{uuid.uuid4().hex}"
    write(documents, path, vocabulary)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
