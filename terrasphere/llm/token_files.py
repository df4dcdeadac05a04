"""Token-id files: one zstandard frame per document, all with one shared dictionary.

A file is a Parquet folder of segments in ascending doc_id order. A segment holds the frames of a run of documents
back to back (`blob`), their ids (`doc_ids`), where each frame starts (`offsets`), how many token ids it holds
(`n_tokens`), the width of an id in bytes and the hash of the dictionary, so that one short document is read by one
seek and one small decompression. The dictionary is a row of its own beside the segments.

NULL texts are empty and hold the end id alone; repeated doc_ids follow each other, ordered by text; an empty table
gives no segments; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasphere.llm.tables import pieces, scratch, table
from terrasphere.llm.tokens import encoder, vocabulary

SAMPLE_DOCUMENTS = 1000
DICTIONARY_BYTES = 64 << 10
SEGMENT_BYTES = 4 << 20
SEGMENTS = ("part long, seq long, doc_ids array<long>, offsets array<long>, n_tokens array<long>, "
            "id_bytes int, dictionary_hash string, blob binary")


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary from the serialised ids of the documents of smallest hash, at most `sample` of them."""
    chosen = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # at most `sample` numbers

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in pieces(batches, "text"):
            ids, bounds = known.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].astype("<u2").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in rows.mapInArrow(serialise, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: they are the dictionary
        return b"".join(samples)[:size]


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _dict(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, segment: int = SEGMENT_BYTES) -> bytes:
    """Encode, compress and write all documents; returns the dictionary."""
    spark, path = docs.sparkSession, path or vocabulary()
    dictionary = train_dictionary(docs, path)
    name = dictionary_hash(dictionary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, press = encoder(path), zstandard.ZstdCompressor(level=3, dict_data=_dict(dictionary), write_content_size=True)
        part, seq, ids_of, counts, frames, held = 0, 0, [], [], [], 0

        def out():
            off = np.cumsum([0, *map(len, frames)])[:-1]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([ids_of], pa.list_(pa.int64())), pa.array([off.tolist()], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([2], pa.int32()), pa.array([name]), pa.array([b"".join(frames)], pa.binary())],
                ["part", "seq", "doc_ids", "offsets", "n_tokens", "id_bytes", "dictionary_hash", "blob"])

        for batch in pieces(batches, "text"):
            ids, bounds = known.encode(batch.column("text"))
            small = ids.astype("<u2")
            part = batch.column("part")[0].as_py()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:]):
                frames.append(press.compress(small[a:b].tobytes()))
                ids_of.append(doc)
                counts.append(int(b - a))
                held += len(frames[-1])
                if held >= segment:
                    yield out()
                    seq, ids_of, counts, frames, held = seq + 1, [], [], [], 0
        if frames:
            yield out()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text").mapInArrow(compress, SEGMENTS).write.option("compression", "none").parquet(f"{folder}/segments")
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary_hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    return dictionary


def read_token_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents in the files (part, seq, doc_id, inside, n_tokens, ids), and the number of ids before each
    segment (part, seq, before). ids are little-endian unsigned 32-bit integers; inside counts from the segment."""
    dictionary = {r.dictionary_hash: bytes(r.dictionary) for r in spark.read.parquet(f"{folder}/dictionary").collect()}
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {k: batch.column(k)[row].as_py() for k in ("part", "seq", "doc_ids", "offsets", "n_tokens", "dictionary_hash", "blob")}
                d = zstandard.ZstdDecompressor(dict_data=_dict(dictionary[x["dictionary_hash"]]))
                ends = [*x["offsets"][1:], len(x["blob"])]
                inside = np.cumsum([0, *x["n_tokens"]])
                step = max(1, int(len(ends) * (4 << 20) / max(1, 4 * inside[-1])))
                for i in range(0, len(ends), step):
                    j = min(len(ends), i + step)
                    ids = [np.frombuffer(d.decompress(x["blob"][a:b]), "<u2").astype("<u4").tobytes() for a, b in zip(x["offsets"][i:j], ends[i:j])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["part"]] * (j - i), pa.int64()), pa.array([x["seq"]] * (j - i), pa.int64()), pa.array(x["doc_ids"][i:j], pa.int64()),
                         pa.array(inside[i:j], pa.int64()), pa.array(x["n_tokens"][i:j], pa.int64()), pa.array(ids, pa.binary())],
                        ["part", "seq", "doc_id", "inside", "n_tokens", "ids"])

    docs = segments.mapInArrow(expand, "part long, seq long, doc_id long, inside long, n_tokens long, ids binary")
    docs = docs.select("part", "seq", "doc_id", "inside", "n_tokens", "ids")
    # tokens before each segment: summed over the files' parts (as many as tasks), then inside each part
    seg = segments.select("part", "seq", F.expr("aggregate(n_tokens, 0L, (s, x) -> s + x)").alias("n"))
    parts = seg.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    seg = seg.select("part", "seq", F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_seg"))
    before = seg.join(parts, "part").select("part", "seq", (F.col("before_part") + F.col("before_seg")).alias("before"))
    return docs, before


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read them back and describe what was read."""
    folder = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    docs, before = read_token_files(spark, folder)
    # the ids are reduced to their checksum before the join
    docs = docs.select("part", "seq", "doc_id", "inside", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op4_token_files": op4_token_files}
ORACLE: dict[str, str] = {}
