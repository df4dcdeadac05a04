"""Removal of repeated byte strings by suffix arrays.

Every string of LENGTH bytes has an anchor: the 32-byte string of smallest hash inside it, the leftmost if tied. Equal
strings have equal anchors, so a string can only repeat where its anchor does, and whatever shares an anchor meets in
one shard. A document becomes runs of neighbouring strings with one anchor, about one run for every 185 bytes, of
which only hashes are kept:

1. Anchors met once are done. Runs whose whole bytes recur are repeated as a whole.
2. Of anchors that have a run of bytes met once beside other runs, one copy of each different run is fetched. A shard
   is the text of such runs; its suffix array is induced (suffixes.py) and its permuted common prefixes show which
   strings are shared. An anchor with more text than HOT_BYTES is not sorted in one task: its strings are counted by
   their 128-bit hashes instead, which Spark sums before it shuffles.
3. The repeated strings of a document are merged into spans and cut out of its bytes.

NULL and empty texts have no bytes; rows that are equal in doc_id and text are different documents that repeat each
other; an empty table gives no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.suffixes import common_prefixes, suffix_array
from terrasphere.llm.tables import bit_field, offsets_of, pieces, ranges, stored, table, whole_groups
from terrasphere.llm.words import flat, mix, powers, prefix_hash, span_hash

LENGTH = 400
GRAM = 32
CHUNK = 8 << 20
SHARD_BYTES = 2 << 20
HOT_BYTES = 4 << 20
POSITION = np.uint64((1 << 24) - 1)


def _window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first start, last start, anchor, hash of the run's bytes); positions count from the data's start."""
    for base in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = data[base : base + CHUNK + length - 1]
        sums = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        h = span_hash(sums, at, at + gram)
        low = _window_minimum((h & ~POSITION) | at.astype(np.uint64), length - gram + 1)
        first = np.maximum(offsets[:-1] - base, 0)
        many = np.maximum(np.minimum(offsets[1:] - length + 1 - base, len(low)) - first, 0)
        start = ranges(first, many)
        if not len(start):
            continue
        anchor = (low[start] & POSITION).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        s0, s1 = start[new], start[np.r_[new[1:], len(start)] - 1]
        yield np.searchsorted(offsets, s0 + base, side="right") - 1, s0 + base, s1 + base, h[anchor[new]], span_hash(sums, s0, s1 + length)


def shard_repeats(texts: list[np.ndarray], starts: list[int], length: int) -> list[np.ndarray]:
    """For each text, whether each of its first `starts` strings occurs anywhere else in the shard."""
    size = np.array([len(t) for t in texts])
    off = offsets_of(size + 1)
    s = np.ones(off[-1] + 1, np.int32)  # 1 ends a text, 0 the shard
    s[-1] = 0
    s[ranges(off[:-1], size)] = np.concatenate(texts).astype(np.int32) + 2
    sa = suffix_array(s)
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s.astype(np.uint64) + np.uint64(0x7F4A7C15)) * powers(len(s) + 1)[0][:-1], dtype=np.uint64, out=sums[1:])
    fresh = np.zeros(len(s), bool)
    fresh[off[:-1]] = True
    prefix = common_prefixes(s, sa, sums, fresh, int(size.max()) + 1 + length)
    shared = prefix >= length
    shared[sa[:-1]] |= prefix[sa[1:]] >= length
    return [shared[a : a + n] for a, n in zip(off, starts)]


def _spans(shared: np.ndarray, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans covered by the strings that are marked."""
    edge = np.flatnonzero(np.diff(np.r_[False, shared, False].astype(np.int8)))
    return start + edge[::2], start + edge[1::2] - 1 + length


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, a, b): spans of bytes of the documents keyed by xxhash64(doc_id, text) that repeated strings cover."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            key = batch.column("key").to_numpy()
            data, off = flat(batch.column("text"))
            for doc, s0, s1, anchor, run in runs(data, off, length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[doc]), pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(s0 - off[doc]), pa.array(s1 - off[doc])], ["key", "anchor", "run", "s0", "s1"])

    found = stored(keyed.mapInArrow(scan, "key long, anchor long, run long, s0 long, s1 long"), "anchor-runs")
    again = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors-met-again")
    found = stored(found.join(again, "anchor"), "repeated-anchors")
    kinds = found.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "s0", "s1")).alias("x"))
    kinds = stored(kinds.select("anchor", "run", "n", "x.*"), "run-kinds")
    whole = found.join(kinds.where("n > 1").select("anchor", "run"), ["anchor", "run"]).select("key", F.col("s0").alias("a"), (F.col("s1") + length).alias("b"))
    open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.sum(F.col("s1") - F.col("s0") + length).alias("bytes"))
    open_ = open_.where("kinds > 1 AND least = 1").select("anchor", (F.col("bytes") > HOT_BYTES).alias("hot"))
    wanted = kinds.join(open_, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "hot", (F.col("n") == 1).alias("single"), "s0", "s1")).alias("wanted"))
    wanted = stored(wanted, "wanted-runs")
    field = docs.sparkSession.sparkContext.broadcast(bit_field(wanted.select(F.xxhash64("key").alias("h")), "h"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(field.value).view(bool)
        for batch in batches:
            cell = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(40)).astype(np.int64)
            yield batch.filter(pa.array(known[cell])).select(["key", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, off = flat(batch.column("text"))
            lists = batch.column("wanted")
            n = np.diff(lists.offsets.to_numpy())
            x = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), n)
            s0, s1 = x.field("s0").to_numpy(), x.field("s1").to_numpy()
            raw, at = data.tobytes(), off[doc]
            yield pa.RecordBatch.from_arrays(
                [x.field("anchor"), x.field("hot"), x.field("single"), pa.array(batch.column("key").to_numpy()[doc]), x.field("s0"), x.field("s1"),
                 pa.array([raw[a:b] for a, b in zip(at + s0, at + s1 + length)], pa.binary())], ["anchor", "hot", "single", "key", "s0", "s1", "bytes"])

    texts = keyed.withColumn("h", F.xxhash64("key")).mapInArrow(some, "key long, text string")
    segments = texts.join(wanted, "key").mapInArrow(cut, "anchor long, hot boolean, single boolean, key long, s0 long, s1 long, bytes binary")
    segments = stored(segments, "segments")

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def shard():
            t = pa.concat_tables(held)
            single = t.column("single").to_numpy(zero_copy_only=False).astype(bool)
            keys, s0, s1 = (t.column(c).to_numpy() for c in ("key", "s0", "s1"))
            marks = shard_repeats([np.frombuffer(x, np.uint8) for x in t.column("bytes").to_pylist()], (s1 - s0 + 1).tolist(), length)
            spans = [(keys[k], *_spans(m, s0[k], length)) for k, m in enumerate(marks) if single[k] and m.any()]
            n = [len(a) for _, a, _ in spans]
            flat_ = lambda e: np.concatenate([x[e] for x in spans]) if spans else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _, _ in spans], n).astype(np.int64)), pa.array(flat_(1)), pa.array(flat_(2))], ["key", "a", "b"])

        for t in whole_groups(batches, "anchor"):
            # groups of one table go to shards of about SHARD_BYTES each
            anchor = t.column("anchor").to_numpy()
            many = offsets_of(t.column("s1").to_numpy() - t.column("s0").to_numpy() + length)
            ends = np.r_[np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)]
            at = 0
            for e in ends:
                if size + many[e] - many[at] >= SHARD_BYTES or e == ends[-1]:
                    held.append(t.slice(at, e - at))
                    size += many[e] - many[at]
                    at = e
                    if size >= SHARD_BYTES:
                        yield shard()
                        held, size = [], 0
        if held:
            yield shard()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, s0, single = batch.column("key").to_numpy(), batch.column("s0").to_numpy(), batch.column("single")
            for k, x in enumerate(batch.column("bytes").to_pylist()):
                sums = prefix_hash(np.frombuffer(x, np.uint8))
                at = np.arange(len(x) - length + 1)
                half = at + length // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), key[k])), pa.array(np.full(len(at), single[k].as_py())), pa.array(at + s0[k]),
                     pa.array(span_hash(sums, at, half).view(np.int64)), pa.array(span_hash(sums, half, at + length).view(np.int64))], ["key", "single", "at", "h1", "h2"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = segments.where("NOT hot").repartition(parts, "anchor").sortWithinPartitions("anchor")
    shared = plain.select("anchor", "single", "key", "s0", "s1", "bytes").mapInArrow(induce, "key long, a long, b long")
    each = segments.where("hot").select("key", "single", "s0", "bytes").mapInArrow(strings, "key long, single boolean, at long, h1 long, h2 long")
    met = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    hot = each.where("single").join(met, ["h1", "h2"]).select("key", F.col("at").alias("a"), (F.col("at") + length).alias("b"))
    return whole.unionByName(shared).unionByName(hot)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes of every document that no repeated string covers."""
    spans = stored(repeated(docs, length, gram), "repeated-spans").groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, off = flat(batch.column("text"))
            raw = data.tobytes()
            removed, count, kept = [], [], []
            lists = batch.column("spans")
            per = lists.offsets.to_numpy()
            x = lists.flatten()
            base = per[0]
            a, b = x.field("a").to_numpy(), x.field("b").to_numpy()
            for k in range(batch.num_rows):
                lo, hi = per[k] - base, per[k + 1] - base
                if lo == hi or not lists[k].is_valid:
                    removed.append(0)
                    count.append(0)
                    kept.append(raw[off[k] : off[k + 1]])
                    continue
                order = np.argsort(a[lo:hi], kind="stable")
                start, end = a[lo:hi][order], np.maximum.accumulate(b[lo:hi][order])
                new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                start, end = start[new], end[np.r_[new[1:], len(end)] - 1]
                removed.append(int((end - start).sum()))
                count.append(len(start))
                kept.append(b"".join(raw[off[k] + p : off[k] + q] for p, q in zip(np.r_[0, end], np.r_[start, off[k + 1] - off[k]])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))
    none = F.array().cast("array<struct<a: long, b: long>>")
    joined = keyed.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur elsewhere."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    # a cut may fall inside a character; the text shows what is left of one as a replacement character
    kept_text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept_text)


QUERIES = {"op8_repeated_spans": op8_repeated_spans}
ORACLE: dict[str, str] = {}
