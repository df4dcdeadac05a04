"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every document's set of five-word shingles is hashed once; its k smallest values are its sketch. Equal sets are one
   class from here on, so exact copies are never compared.
2. Inverted lists over the retained values generate overlaps. The values of a sketch are ordered by how many sketches
   hold them; two sketches that must share m of k values share one among the k - m + 1 rarest, so only those are
   listed, and values of a single sketch need no list. Long lists are dealt out as pairs of blocks.
3. Where two sketches meet, the k smallest values of their union estimate the Jaccard similarity; pairs more than five
   standard deviations below the threshold go. A task hands on a spanning forest of what is left, not its pairs.
4. The families so joined are compared on full shingle sets, again by blocks, and the exact links' spanning forests
   give the components.

NULL, empty and blank texts have no shingles and link with nothing. Rows of one doc_id whose texts are no copies of each
other are not linked by it: each belongs to the component of its own text. A row without doc_id links with nothing and is kept. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.graph import components
from terrasphere.llm.tables import bit_field, in_blocks, offsets_of, pieces, ranges, stored, table, whole_groups
from terrasphere.llm.words import SPACED, mix, shingles

SKETCH = 64
WORDS = 5
PERCENT = 85
SIGMAS = 5.0
LIST_BLOCK = 512
FAMILY_BLOCK = 256
PAD = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(docs: DataFrame, k: int = SKETCH, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, n, k1, k2, sketch): hash of the text, number of shingles, 128-bit key of the whole set, the k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            doc, v = shingles(batch.column("text"), SPACED, words)
            n = np.bincount(doc, minlength=batch.num_rows)
            off = offsets_of(n)
            keys = []
            for salt in (0x51ED270B, 0x2545F491):
                sums = np.zeros(len(v) + 1, np.uint64)
                np.cumsum(mix(v ^ np.uint64(salt)), dtype=np.uint64, out=sums[1:])
                keys.append((sums[off[1:]] - sums[off[:-1]]).view(np.int64))
            few = np.minimum(n, k)
            kept = v[ranges(off[:-1], few)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(pa.array(offsets_of(few), pa.int32()), pa.array(kept))],
                ["doc_id", "text_key", "n", "k1", "k2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n long, k1 long, k2 long, sketch array<long>")


def least_shared(size, k: int, percent: int = PERCENT):
    """Values that two sketches surely share if the documents link (up to the tail of the estimate)."""
    p = percent / 100
    sure = int(p * k - SIGMAS * (k * p * (1 - p)) ** 0.5)
    return F.least(F.ceil(size * F.lit(percent) / 100), F.lit(sure)).cast("int")


def lists(classes: DataFrame, k: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """(v, id): each class under the rarest values of its sketch, values of one class left out."""
    values = classes.select("id", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    held = values.join(common, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("held"))
    size = F.size("sketch")
    room = size - least_shared(size, k, percent) + 1 - (size - F.size("held"))
    chosen = classes.select("id", "sketch").join(held, "id").select("id", F.explode(F.slice("held", F.lit(1), F.greatest(room, F.lit(0)))).alias("x"))
    return chosen.select("id", "x.v")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of padded sketches, and how many union values each rests on."""
    k = a.shape[1]
    c = np.concatenate([a, b], axis=1)
    c.sort(axis=1)
    real = c != PAD
    twice = (c[:, 1:] == c[:, :-1]) & real[:, 1:]
    rank = real.cumsum(axis=1)
    rank[:, 1:] -= twice.cumsum(axis=1)
    base = np.maximum(np.minimum(rank[:, -1], k), 1)
    return (twice & (rank[:, 1:] <= base[:, None])).sum(axis=1) / base, base


def _close(s: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs are not surely below the threshold."""
    out = np.zeros(len(i), bool)
    p, k = percent / 100, s.shape[1]
    fit = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    for at in range(0, len(fit), 20_000):
        x = fit[at : at + 20_000]
        e, base = estimate(s[i[x]], s[j[x]])
        exact = (n[i[x]] <= k) & (n[j[x]] <= k) & (base < k)
        out[x] = e >= p - np.where(exact, 1e-9, SIGMAS * np.sqrt(p * (1 - p) / base))
    return out


def join_up(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i - j: each the smallest row reachable."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label != label[label]).any():
            label = label[label]
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
    return label


def overlaps(values: np.ndarray, row: np.ndarray, rows: int, width: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections of few sets, as sums of products of 0/1 columns."""
    v, col, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n[col] > 1
    number = np.cumsum(n > 1) - 1
    col, row = number[col[shared]], row[shared]
    out = np.zeros((rows, rows), np.float32)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for start in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(col, [start, start + width])
        m = np.zeros((rows, min(width, int(col[b - 1]) - start + 1)), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _group_edges(s: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Labels of one long list: candidate pairs by overlap, estimated only while they would join something new."""
    p, k, rows = percent / 100, s.shape[1], len(s)
    real = s != PAD
    o = overlaps(s[real], np.nonzero(real)[0], rows)
    held = np.minimum(n, k)
    base = np.minimum(k, held[:, None] + held[None] - o)
    open_ = (o >= (p - SIGMAS * np.sqrt(p * (1 - p) / np.maximum(base, 1))) * base) & (100 * np.minimum(n[:, None], n[None]) >= percent * np.maximum(n[:, None], n[None]))
    i, j = np.nonzero(np.triu(open_, 1))
    best = np.argsort(-o[i, j], kind="stable")
    i, j, label = i[best], j[best], np.arange(rows)
    while len(i):
        x, y = i[:20_000], j[:20_000]
        near = _close(s, n, x, y, percent)
        label = join_up(label, x[near], y[near])
        i, j = i[20_000:], j[20_000:]
        rest = label[i] != label[j]
        i, j = i[rest], j[rest]
    return label


def _edges(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    x = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[label[x]]), pa.array(ids[x])], ["a", "b"])


def candidates(listed: DataFrame, k: int = SKETCH, percent: int = PERCENT) -> DataFrame:
    """Spanning forests (a, b) of the pairs that meet in a list and are not surely too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            g, ids, n = (t.column(c).to_numpy() for c in ("g", "id", "n"))
            lens = np.minimum(n, k)
            s = np.full((len(ids), k), PAD, np.uint64)
            s[np.repeat(np.arange(len(ids)), lens), ranges(np.zeros(len(ids)), lens)] = pa.concat_arrays(t.column("sketch").chunks).flatten().to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sizes = np.diff(np.r_[starts, len(g)])
            label = np.arange(len(ids))
            i, j = [], []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
                x, y = np.triu_indices(size, 1)
                at = starts[sizes == size][:, None]
                i.append((at + x).ravel())
                j.append((at + y).ravel())
            if i:
                i, j = np.concatenate(i), np.concatenate(j)
                near = _close(s, n, i, j, percent)
                label = join_up(label, i[near], j[near])
            for a, size in zip(starts[sizes > 32], sizes[sizes > 32]):
                label[a : a + size] = a + _group_edges(s[a : a + size], n[a : a + size], percent)
            yield _edges(ids, label)

    return listed.select("g", "id", "n", "sketch").mapInArrow(run, "a long, b long")


def links(families: DataFrame, docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """Spanning forests (a, b) of the exact links inside families (id, family)."""
    field = docs.sparkSession.sparkContext.broadcast(bit_field(families.select(F.xxhash64("id").alias("h")), "h"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(field.value).view(bool)
        for batch in batches:
            cell = batch.column("h").to_numpy().view(np.uint64) >> np.uint64(40)
            some = batch.filter(pa.array(known[cell.astype(np.int64)]))
            for part in pieces(iter([some]), "text"):
                doc, v = shingles(part.column("text"), SPACED, words)
                off = offsets_of(np.bincount(doc, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v.view(np.int64)))], ["id", "shingles"])

    sets = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("doc_id"))
    sets = sets.mapInArrow(full_sets, "id long, shingles array<long>")
    size = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    members = in_blocks(families.join(size, "family").join(sets, "id"), "family", "size", FAMILY_BLOCK)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            g, ids = t.column("g").to_numpy(), t.column("id").to_numpy()
            lists_ = pa.concat_arrays(t.column("shingles").chunks)
            off, v = lists_.offsets.to_numpy(), lists_.values.to_numpy()
            n = np.diff(off)
            label = np.arange(len(ids))
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(g)]):
                if b - a > 1:
                    m = n[a:b]
                    o = overlaps(v[off[a] : off[b]], np.repeat(np.arange(b - a), m), b - a)
                    i, j = np.nonzero(np.triu((o > 0) & (100 * o >= percent * (m[:, None] + m[None] - o)), 1))
                    label[a:b] = a + join_up(np.arange(b - a), i, j)
            yield _edges(ids, label)

    return members.select("g", "id", "shingles").mapInArrow(verify, "a long, b long")


def near_copies(docs: DataFrame, percent: int = PERCENT, k: int = SKETCH, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every document."""
    made = stored(sketches(docs, k, words), "sketches")
    key = ["n", "k1", "k2"]
    classes = made.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    listed = stored(lists(classes, k, percent), "sketch-lists")
    size = listed.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = listed.join(size, "v").join(classes.select("id", "n", "sketch"), "id")
    families = components(candidates(in_blocks(rows, "v", "size", LIST_BLOCK), k, percent)).withColumnRenamed("component_id", "family")
    found = components(links(stored(families, "families"), docs, percent, words))
    named = classes.join(found, "id", "left").select(*key, F.coalesce("component_id", "id").alias("component_id"))
    out = made.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "text_key", *key).join(named, key).select("doc_id", "text_key", "n", "component_id")
    alone = made.where("n = 0 OR doc_id IS NULL").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 85 % of their five-word shingles."""
    return near_copies(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op2_near_copies": op2_near_copies}
ORACLE: dict[str, str] = {}
