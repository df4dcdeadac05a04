"""Near-duplicate embeddings by product quantisation.

Vectors of one label that are equal bit by bit are one class. From a bounded sample the driver learns coarse
centroids and, for the residuals, a small codebook in each subspace. Every class is put in the inverted list of its
nearest centroid with its codes and the error of its code. A class probes every list that can hold a partner: for unit
vectors a cosine bound is a distance bound, and a list is passed over only if the triangle inequality (against its
smallest and largest residual) or the distance to the border between two cells rules a partner out. In a list,
asymmetric distances come from look-up tables; a pair goes on if its table distance is within the bound plus the
code's own error, so none is lost; the rest is compared by exact cosine in double precision. Long lists and their
queries are dealt in blocks; a task returns link counts and a spanning forest, never its pairs.

Vectors that are NULL, empty, zero or hold NULL or non-finite components, and those without a label or vec_id, link
with nothing. Vectors of different lengths do not link. Rows of equal vec_id but different vectors are not linked by it:
each belongs to the component of its own vector. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.graph import components
from terrasphere.llm.near_copies import join_up
from terrasphere.llm.tables import stored, table, whole_groups

COSINE = 0.93
SAMPLE_VECTORS = 10_000
LISTS = 32
SUBSPACES = 8
CODES = 32
BLOCK = 1024
QUERIES_BLOCK = 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (c**2).sum(axis=1)[None] - 2 * x @ c.T
        own = near.argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.coarse = _kmeans(x, min(lists, len(x)), rng)
        residual = x - self.coarse[self.nearest(x)]
        self.cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        self.books = [_kmeans(residual[:, a:b], min(codes, len(x)), rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distance of every row to every centroid."""
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (self.coarse**2).sum(axis=1)[None] - 2 * x @ self.coarse.T, 0))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the distance between each vector and what its codes stand for."""
        residual = x - self.coarse[cell]
        codes = np.stack([((b**2).sum(axis=1)[None] - 2 * residual[:, s:e] @ b.T).argmin(axis=1) for b, s, e in zip(self.books, self.cuts, self.cuts[1:])], axis=1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(axis=1))

    def table_distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (list row, query) from one look-up table for each subspace."""
        shifted = q - self.coarse[cell]
        total = np.zeros((len(codes), len(q)), np.float32)
        for m, (b, s, e) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            part = shifted[:, s:e]
            near = (b**2).sum(axis=1)[:, None] - 2 * b @ part.T + (part**2).sum(axis=1)[None]
            total += near.astype(np.float32)[codes[:, m]]
        return np.sqrt(np.maximum(total, 0))

    def probes(self, x: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
        """Which lists (columns) can hold a vector within reach of each row."""
        d = self.distances(x)
        own = d[np.arange(len(x)), cell]
        apart = np.sqrt(np.maximum(((self.coarse[cell][:, None] - self.coarse[None]) ** 2).sum(axis=2), 1e-30))
        border = (d**2 - own[:, None] ** 2) / (2 * apart)
        return (d - reach <= high[None]) & (d + reach >= low[None]) & (border <= reach)


def _matrix(column: pa.Array) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(id, label, vec, ok): every row, and whether it can link."""
    out = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ok = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0)
    return out.withColumn("ok", F.coalesce(ok, F.lit(False)))


def _learn(classes: DataFrame, sample: int) -> dict[int, Quantiser]:
    """A quantiser for every vector length, from the classes of smallest hash."""
    rows = classes.select("dim", "vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("dim", "vec").toArrow()
    dims = rows.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims):
        x = _unit(_matrix(rows.filter(pa.array(dims == dim)).column("vec")))
        out[int(dim)] = Quantiser(x)
    return out


def linked(rows: DataFrame, cosine: float = COSINE, sample: int = SAMPLE_VECTORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    every = usable_vectors(rows)
    # -0.0 and 0.0 are the same number, so they must hash alike
    keyed = every.where("ok").select("id", "label", F.size("vec").alias("dim"), F.transform("vec", lambda v: v + F.lit(0.0)).alias("vec"))
    keyed = keyed.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(17), F.reverse("vec"))})
    key = ["label", "dim", "k1", "k2"]
    classes = keyed.groupBy(*key).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = stored(classes.withColumn("id", F.xxhash64(*key)), "vector-classes")  # id: of the class
    models = _learn(classes, sample)
    shared = spark.sparkContext.broadcast(models)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                q = shared.value.get(int(dim))
                x = _unit(_matrix(part.column("vec")))
                if q is None:  # a length the sample does not hold: one list, and codes that say nothing
                    cell, codes, error, away = np.zeros(len(x), int), np.zeros((len(x), 0), np.uint8), np.full(len(x), 9.0), np.zeros(len(x))
                else:
                    d = q.distances(x)
                    cell = d.argmin(axis=1)
                    away = d[np.arange(len(x)), cell]
                    codes, error = q.encode(x, cell)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), part.column("dim"), part.column("copies"), part.column("vec"), pa.array(cell, pa.int32()),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(away)],
                    ["id", "label", "dim", "copies", "vec", "cell", "codes", "error", "away"])

    coded = classes.select("id", "label", "dim", "copies", "vec").mapInArrow(
        encode, "id long, label string, dim int, copies long, vec array<double>, cell int, codes binary, error double, away double")
    coded = stored(coded, "vector-codes")
    # residual ranges of the lists: at most LISTS rows for each vector length
    spans = {(r.dim, r.cell): (r.low, r.high) for r in coded.groupBy("dim", "cell").agg(F.min("away").alias("low"), F.max("away").alias("high")).collect()}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = batch.column("cell").to_numpy()
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                q = shared.value.get(int(dim))
                if q is None:
                    for k in at:
                        found[k] = [0]
                    continue
                low, high = (np.array([spans.get((int(dim), c), (9.0, -9.0))[e] for c in range(len(q.coarse))]) for e in (0, 1))
                for part in np.array_split(at, len(at) // 2048 + 1):
                    x = _unit(_matrix(batch.column("vec").take(pa.array(part))))
                    hit = q.probes(x, cell[part], low - 1e-6, high + 1e-6, reach)
                    hit[np.arange(len(part)), cell[part]] = True
                    for k, row in zip(part, hit):
                        found[k] = [int(c) for c in np.flatnonzero(row) if c >= cell[k]]  # a pair meets in the later of its two lists
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "probed"])

    probed = coded.mapInArrow(probe, "id long, label string, dim int, copies long, vec array<double>, cell int, codes binary, error double, away double, probed array<int>")
    length = coded.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = coded.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES_BLOCK).cast("int").alias("q_blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    q_block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("q_blocks")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stay = ["id", "label", "dim", "copies", "vec", "codes", "error"]
    members = coded.join(length, ["label", "dim", "cell"]).join(asked, ["label", "dim"]).select(
        *stay, "cell", F.lit(True).alias("listed"), F.lit(False).alias("own"), block.alias("l"), each("q_blocks").alias("q"))
    queries = probed.withColumn("home", F.col("cell")).withColumn("cell", F.explode("probed")).join(length, ["label", "dim", "cell"]).join(asked, ["label", "dim"]).select(
        *stay, "cell", F.lit(False).alias("listed"), (F.col("cell") == F.col("home")).alias("own"), each("blocks").alias("l"), q_block.alias("q"))
    dealt = members.unionByName(queries).withColumn("g", F.xxhash64("label", "dim", "cell", "l", "q"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "g").sortWithinPartitions("g", F.col("listed").desc())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            g = t.column("g").to_numpy()
            ids, copies, error, dims, cells = (t.column(c).to_numpy() for c in ("id", "copies", "error", "dim", "cell"))
            listed, own = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("listed", "own"))
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(g)]):
                middle = a + int(listed[a:b].sum())
                if middle == a or middle == b:
                    continue
                x = _matrix(t.column("vec").slice(a, b - a))
                norm = np.sqrt((x**2).sum(axis=1))
                unit = x / norm[:, None]
                rows, q = middle - a, shared.value.get(int(dims[a]))
                counts, label = np.zeros(b - a, np.int64), np.arange(b - a)
                raw = pa.concat_arrays(t.column("codes").slice(a, rows).chunks)
                for s in range(rows, b - a, 1024):
                    e = min(b - a, s + 1024)
                    if q is None:
                        near = np.ones((rows, e - s), bool)
                    else:
                        codes = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(rows, -1)
                        near = q.table_distances(unit[s:e], int(cells[a]), codes) <= (reach + 1e-4 + error[a:middle])[:, None]
                    # inside one list a pair is met twice, from either side: keep the one whose query is the larger id
                    near &= ~own[a + s : a + e][None] | (ids[a:middle][:, None] < ids[a + s : a + e][None])
                    up, over = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    if not len(up):
                        continue
                    cos = (x[up] @ x[s + over].T) / (norm[up][:, None] * norm[s + over][None])
                    i, j = np.nonzero((cos >= cosine) & near[np.ix_(up, over)])
                    i, j = up[i], s + over[j]
                    counts += np.bincount(i, copies[a + j], b - a).astype(np.int64) + np.bincount(j, copies[a + i], b - a).astype(np.int64)
                    label = join_up(label, i, j)
                some = np.flatnonzero(counts)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + some]), pa.array(ids[a + label[some]]), pa.array(counts[some])], ["a", "b", "n"])

    met = stored(dealt.select("g", "id", "copies", "dim", "cell", "vec", "codes", "error", "listed", "own").mapInArrow(compare, "a long, b long, n long"), "vector-links")
    number = met.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    found = components(met.where("a <> b").select("a", "b"))
    named = classes.drop("vec").join(number, "id", "left").join(found, "id", "left").withColumn("component", F.coalesce("component_id", "id"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("smallest"))
    named = named.join(smallest, "component").select(*key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("smallest").alias("component_id"))
    good = keyed.select("id", *key).join(named, key).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    rest = every.where("NOT ok").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of at least cosine 0.93 among the embeddings of one label."""
    return linked(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_vector_links": op1_vector_links}
ORACLE: dict[str, str] = {}
