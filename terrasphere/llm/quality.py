"""Document quality by supervised subword embeddings.

A document is the mean of the vectors of its words and of the character 3- to 5-grams inside them, all hashed into
one table of learned vectors; a softmax over two classes reads the mean. Vectors and output are trained on the driver
by numpy stochastic gradient descent from a bounded sample of labelled documents (SAMPLE_DOCUMENTS, those of smallest
hash), whose whole texts are turned into feature counts by tasks. After training the product of every vector with the
output is one number, so scoring a document is a mean of table look-ups over its whole text.

Rows whose crc32(doc_id as text) mod 5 is 0 are never learned from. NULL and empty texts have no features and get the
score of the bias alone; so does every document if there are no labels. Repeated rows are scored alike; repeated or
contradicting labels all count in training; labels other than 0 and 1 are ignored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import offsets_of, pieces, table
from terrasphere.llm.words import SPACED, flat, prefix_hash, span_hash, split

SAMPLE_DOCUMENTS = 2500
BUCKETS = 1 << 17
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.1
BATCH = 32
GRAMS = (3, 4, 5)
REPEATS = 8
CUT = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, feature, share): a text is the mean of its words, a word the mean of itself and its n-grams.

    The word n-grams are those of a word with an equal one up to REPEATS words before it; as such pairs are told by
    their distance alone, they stand for repetition in any language.
    """
    data, offsets = flat(texts)
    doc, starts, ends = split(data, offsets, SPACED)
    sums = prefix_hash(data)
    mask = np.uint64(BUCKETS - 1)
    size = ends - starts
    words = np.bincount(doc, minlength=len(texts))
    each = 1.0 / words[doc]
    share = each / (1 + sum(np.maximum(size - n + 1, 0) for n in GRAMS))
    word = span_hash(sums, starts, ends)
    yield doc, (word & mask).astype(np.int32), share
    for n in GRAMS:
        long_ = size >= n
        run = size[long_] - n + 1
        at = np.repeat(starts[long_] - offsets_of(run)[:-1], run) + np.arange(run.sum())
        yield np.repeat(doc[long_], run), (span_hash(sums, at, at + n) & mask).astype(np.int32), np.repeat(share[long_], run)
    for d in range(1, REPEATS + 1):
        again = np.flatnonzero((word[d:] == word[:-d]) & (doc[d:] == doc[:-d])) + d
        yield doc[again], np.full(len(again), BUCKETS + d - 1, np.int32), each[again]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each document and their shares."""
    for batch in pieces(batches, "text"):
        doc, f, share = (np.concatenate(x) for x in zip(*features(batch.column("text"))))
        key, where = np.unique(doc * (2 * BUCKETS) + f, return_inverse=True)
        per = np.bincount(key // (2 * BUCKETS), minlength=batch.num_rows)
        off = pa.array(offsets_of(per), pa.int32())
        total = np.bincount(where, share, len(key)).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.ListArray.from_arrays(off, pa.array((key % (2 * BUCKETS)).astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(total))],
            ["label", "features", "shares"])


def sample(docs: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(label, text) of at most `size` labelled documents outside the held-out fold."""
    known = labels.where(~held_out() & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("d"), F.col(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("d"), "d", "label").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("d")).select("label", "text")  # at most `size` rows of two numbers


def train(rows: DataFrame, seed: int = 7) -> tuple[np.ndarray, float]:
    """A weight for every feature, and the bias: the log-odds of label 1 are the bias plus the shares' weights."""
    got = rows.mapInArrow(_counts, "label int, features array<int>, shares array<float>").toArrow().combine_chunks()
    y = np.asarray(got.column("label").to_pylist(), np.float32)
    rng = np.random.default_rng(seed)
    if not len(y):
        return np.zeros(BUCKETS + REPEATS, np.float32), 0.0
    lists = pa.concat_arrays(got.column("features").chunks)
    off, f = lists.offsets.to_numpy(), lists.values.to_numpy()
    share = pa.concat_arrays(got.column("shares").chunks).values.to_numpy()
    order = np.lexsort((np.diff(off), np.add.reduceat(np.r_[f, 0], off[:-1]) if len(f) else y, y))  # the same whatever order tasks end in
    vectors = rng.uniform(-1, 1, (BUCKETS + REPEATS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    had, had_out, had_bias = np.zeros(BUCKETS + REPEATS, np.float32), np.zeros_like(out), np.zeros_like(bias)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32) * len(y)
    steps, done = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(order)
        for k in range(0, len(y), BATCH):
            docs = shuffled[k : k + BATCH]
            n = off[docs + 1] - off[docs]
            at = np.repeat(off[docs] - offsets_of(n)[:-1], n) + np.arange(n.sum())
            row = np.repeat(np.arange(len(docs)), n)
            fs, ws = f[at], share[at]
            picked = vectors[fs]
            mean = np.zeros((len(docs), DIMENSIONS), np.float32)
            full = np.flatnonzero(n)
            if len(fs):
                mean[full] = np.add.reduceat(picked * ws[:, None], offsets_of(n)[:-1][full])
            z = mean @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            grad = z / z.sum(axis=1, keepdims=True)
            grad[np.arange(len(docs)), y[docs].astype(int)] -= 1
            grad *= weight[docs][:, None]
            rate = RATE * (1 - done / steps)
            back = grad @ out.T
            g_out, g_bias = mean.T @ grad, grad.sum(axis=0)
            met, where = np.unique(fs, return_inverse=True)
            g = np.stack([np.bincount(where, ws * back[row, d], len(met)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            # each parameter's step shrinks with the gradients it has had
            had[met] += (g**2).mean(axis=1)
            had_out += g_out**2
            had_bias += g_bias**2
            vectors[met] -= rate * g / np.sqrt(had[met] + 1e-12)[:, None]
            out -= rate * g_out / np.sqrt(had_out + 1e-12)
            bias -= rate * g_bias / np.sqrt(had_bias + 1e-12)
            done += 1
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], into: str = "score") -> DataFrame:
    """The documents with the probability of label 1 in a new column (which replaces one of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in pieces(batches, "text"):
            total = np.zeros(batch.num_rows)
            for doc, f, share in features(batch.column("text")):
                total += np.bincount(doc, weights=weights[f] * share, minlength=batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(bias + total, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, into])

    clean = docs.drop(into)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in clean.dtypes)
    return clean.mapInArrow(run, f"{schema}, `{into}` double")


def model(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    return train(sample(docs, labels, label))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLE: dict[str, str] = {}
