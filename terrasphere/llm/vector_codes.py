"""Vector codes by product quantisation, with codebooks refined over metric trees of the anchors hierarchy.

Components become integers, vectors are cut into PARTS equal parts, and every part position has a codebook of ENTRIES
entries. The rows are read once into blocks of at most BLOCK vectors; for each part position a block keeps a tree of balls over
its parts, built middle-out: about sqrt(n) anchors are chosen one after the other, each the point farthest from its
anchor so far, which takes over the points that are nearer to it (a point closer to its anchor than half the distance
between the two need not be looked at). Anchors are merged pairwise, most compatible balls first, up to the root, and
each anchor's points are divided in the same way down to leaves. Every ball caches the sum and the number of its points.

A round sends the codebooks (of fixed size) to all blocks. A ball inherits the candidate entries of the ball above
it and strikes out those that lose to the entry nearest to its centre at every point of the ball. If one is left, the
ball is wholly owned, and its cached sum and number go to the entry; the points of leaves that stay contested choose
among the candidates left. Tasks send one sum for each entry; the new codebooks come from their totals.

All decisions are those of exact integers: an entry is struck out only with a margin above rounding errors, equal entries count as
the lower index, and distances of points are exact. Vectors that are NULL, empty or hold NULL or non-finite components are
dropped; so are those whose length is no multiple of PARTS or not that of the first seed. Rows of equal vec_id are
ordered by vector, rows without vec_id come last; fewer vectors than ENTRIES give shorter codebooks. An empty table gives no rows;
other columns are ignored. Components too large for exact distances raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import large_list, offsets_of, ranges, release, stored, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096
LEAF = 16
BALLS = "values array<long>, order array<int>, first array<int>, until array<int>, left array<int>, right array<int>, centre array<double>, radius array<double>, sums array<long>"
HEX = np.array([f"{k:02x}" for k in range(256)])


class Tree:
    """Balls over points (rows of integers): ranges of `values`, children (-1 for a leaf), centres, radii and sums."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.first, self.until, self.left, self.right = [], [], [], []
        self.centre, self.radius, self.sums = [], [], []
        order = np.empty(len(points), np.int64)
        self._place(self._divided(np.arange(len(points))), order, 0)
        self.order, self.values = order, points[order]

    def _anchors(self, rows: np.ndarray, many: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, squared distances to their anchor) of up to `many` anchors; fewer if all points are equal to anchors."""
        x = self.points[rows].astype(np.float64)
        pivots, owner = [0], np.zeros(len(rows), np.int64)
        away = ((x - x[0]) ** 2).sum(axis=1)
        while len(pivots) < many:
            new = int(away.argmax())
            if not away[new]:
                break
            between = ((x[pivots] - x[new]) ** 2).sum(axis=1)
            near = np.flatnonzero(4 * away >= between[owner])
            d = ((x[near] - x[new]) ** 2).sum(axis=1)
            taken = d < away[near]
            owner[near[taken]], away[near[taken]] = len(pivots), d[taken]
            pivots.append(new)
        place = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[place], np.arange(1, len(pivots)))
        return [(rows[p], away[p]) for p in np.split(place, cuts)]

    def _divided(self, rows: np.ndarray):
        """The ball over some points: a leaf (rows, None), or (ball, ball) as anchors were merged."""
        many = int(np.sqrt(len(rows)))
        if len(rows) <= LEAF or many < 2:
            return rows
        anchors = self._anchors(rows, many)
        if len(anchors) == 1:
            return rows
        balls = [self._divided(r) for r, _ in anchors]
        n = np.array([float(len(r)) for r, _ in anchors])
        sums = np.array([self.points[r].sum(axis=0) for r, _ in anchors], np.float64)
        reach = np.array([np.sqrt(((self.points[r] - s / k) ** 2).sum(axis=1).max()) for (r, _), s, k in zip(anchors, sums, n)])
        alive = np.ones(len(balls), bool)
        cost = np.full((len(balls), len(balls)), np.inf)

        def merged(i: int, others: np.ndarray) -> np.ndarray:
            """Radius of the ball over ball i and each of the others, about the centre of all their points."""
            a, b = sums[i] / n[i], sums[others] / n[others, None]
            apart = np.sqrt(((a - b) ** 2).sum(axis=1))
            share = n[others] / (n[i] + n[others])
            return np.maximum(reach[i] + apart * share, reach[others] + apart * (1 - share))

        for i in range(1, len(balls)):
            cost[i, :i] = merged(i, np.arange(i))
        for _ in range(len(balls) - 1):
            i, j = np.unravel_index(int(cost.argmin()), cost.shape)
            reach[j] = cost[i, j]
            balls[j], sums[j], n[j], alive[i] = (balls[j], balls[i]), sums[j] + sums[i], n[j] + n[i], False
            cost[i], cost[:, i] = np.inf, np.inf
            others = np.flatnonzero(alive & (np.arange(len(balls)) != j))
            if len(others):
                new = merged(j, others)
                cost[np.maximum(j, others), np.minimum(j, others)] = new
        return balls[int(np.flatnonzero(alive)[0])]

    def _place(self, ball, order: np.ndarray, at: int) -> tuple[int, int]:
        """Lay out a ball's points from `at`; returns its number and the end of its range. Balls above come first."""
        number = len(self.first)
        for column in (self.first, self.until, self.left, self.right, self.centre, self.radius, self.sums):
            column.append(None)
        self.first[number], self.left[number], self.right[number] = at, -1, -1
        if isinstance(ball, tuple):
            self.left[number], at = self._place(ball[0], order, at)
            self.right[number], at = self._place(ball[1], order, at)
            self.sums[number] = self.sums[self.left[number]] + self.sums[self.right[number]]
        else:
            order[at : at + len(ball)] = ball
            at += len(ball)
            self.sums[number] = self.points[ball].sum(axis=0)
        self.until[number] = at
        x = self.points[order[self.first[number] : at]]
        self.centre[number] = self.sums[number] / len(x)
        self.radius[number] = float(np.sqrt(((x - self.centre[number]) ** 2).sum(axis=1).max()))
        return number, at


class Balls:
    """A stored tree, ready to be asked which entry owns which points."""

    def __init__(self, lists: dict[str, np.ndarray], dim: int):
        self.dim = dim
        self.values, self.centre, self.sums = (lists[c].reshape(-1, dim) for c in ("values", "centre", "sums"))
        self.order, self.first, self.until, self.left, self.right, self.radius = (lists[c] for c in ("order", "first", "until", "left", "right", "radius"))

    def owners(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Wholly owned balls and their entries, the contested points and theirs."""
        entries = book.astype(np.float64)
        square = (entries**2).sum(axis=1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * entries @ entries.T, 0))
        candidates = np.zeros((1, len(book)), bool)
        candidates[0, np.unique(book, axis=0, return_index=True)[1]] = True  # of equal entries the first
        ball, balls, its, points, theirs = np.zeros(1, np.int64), [], [], [], []
        while len(ball):
            centre, radius = self.centre[ball], self.radius[ball]
            size = (centre**2).sum(axis=1)
            d = size[:, None] + square[None] - 2 * centre @ entries.T
            nearest = np.where(candidates, d, np.inf).argmin(axis=1)
            ahead = d - d[np.arange(len(ball)), nearest][:, None]
            margin = 1e-9 * (size[:, None] + square.max() + 1)
            candidates &= ahead <= 2 * radius[:, None] * apart[nearest] + margin
            left = candidates.sum(axis=1)
            owned = left == 1
            balls.append(ball[owned])
            its.append(candidates[owned].argmax(axis=1))
            leaf = ~owned & (self.left[ball] < 0)
            if leaf.any():
                rows = ranges(self.first[ball[leaf]], self.until[ball[leaf]] - self.first[ball[leaf]])
                own = np.repeat(np.flatnonzero(leaf), self.until[ball[leaf]] - self.first[ball[leaf]])
                x = self.values[rows].astype(np.float64)
                # the same number for all entries is left out of the distance; integers, so exact
                points.append(rows)
                theirs.append(np.where(candidates[own], square[None] - 2 * x @ entries.T, np.inf).argmin(axis=1))
            more = np.flatnonzero(~owned & ~leaf)
            ball = np.concatenate([self.left[ball[more]], self.right[ball[more]]]).astype(np.int64)
            candidates = candidates[np.r_[more, more]]
        joined = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return joined(balls), joined(its), joined(points), joined(theirs)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the rows whose vector can be cut into parts."""
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return out.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & (F.size("vec") % PARTS == 0) & finite)


def _whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), checked to be small enough for distances that are exact in doubles."""
    v = np.floor(SCALE * vectors)
    if len(v) and v.shape[1] * np.abs(v).max() ** 2 > 2**53:
        raise ValueError("components are too large for exact distances")
    return v.astype(np.int64)


def trees(kept: DataFrame, dim: int) -> DataFrame:
    """One row per block: ids and labels in the order of reading, and for each part position the balls."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                v = _whole(part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                found = [Tree(x) for x in np.split(v, PARTS, axis=1)]
                columns = []
                for name, kind in (f.split(" array") for f in BALLS.split(", ")):
                    lists = [np.asarray(getattr(t, name)).ravel() for t in found]
                    kind = {"<long>": pa.int64(), "<int>": pa.int32(), "<double>": pa.float64()}[kind]
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets_of([len(x) for x in lists]), pa.int32()), pa.array(np.concatenate(lists)).cast(kind)))
                balls = pa.StructArray.from_arrays(columns, [f.split(" ")[0] for f in BALLS.split(", ")])
                yield pa.RecordBatch.from_arrays(
                    [large_list([0, part.num_rows], part.column("vec_id"), pa.int64()), large_list([0, part.num_rows], part.column("label"), pa.string()),
                     pa.ListArray.from_arrays(pa.array([0, PARTS], pa.int32()), balls)], ["ids", "labels", "parts"])

    shape = ", ".join(f.replace(" ", ": ") for f in BALLS.split(", "))
    return kept.mapInArrow(build, f"ids array<long>, labels array<string>, parts array<struct<{shape}>>")


def _opened(batch: pa.RecordBatch, dim: int) -> Iterator[list[Balls]]:
    """The balls of every part position, for each block of a batch."""
    parts = batch.column("parts")
    for k in range(batch.num_rows):
        inner = parts[k].values
        names = [f.name for f in inner.type]
        yield [Balls({c: inner.field(c)[p].values.to_numpy() for c in names}, dim // PARTS) for p in range(PARTS)]


def refined(blocks: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, every entry to the mean of its parts."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, len(books[0]), dim // PARTS + 1), np.int64)  # the last number counts
        for batch in batches:
            for balls in _opened(batch, dim):
                for p, tree in enumerate(balls):
                    ball, entry, point, chosen = tree.owners(books[p])
                    np.add.at(sums[p], entry, np.c_[tree.sums[ball], tree.until[ball] - tree.first[ball]])
                    np.add.at(sums[p], chosen, np.c_[tree.values[point], np.ones(len(point), np.int64)])
        p, e = np.nonzero(sums[:, :, -1])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), large_list(np.arange(len(p) + 1) * sums.shape[2], sums[p, e].ravel(), pa.int64())], ["part", "entry", "sums"])

    met = blocks.select("parts").mapInArrow(totals, "part int, entry int, sums array<long>")
    met = met.select("part", "entry", F.posexplode("sums").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("x").alias("x"))
    total = np.zeros((PARTS, len(books[0]), dim // PARTS + 1), np.int64)
    for r in met.collect():  # as many numbers as the codebooks hold
        total[r.part, r.entry, r.pos] = r.x
    return [np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(t[:, -1:], 1), book) for t, book in zip(total, books)]


def coded(blocks: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("ids"), batch.column("labels")
            for k, balls in enumerate(_opened(batch, dim)):
                text, error = None, np.zeros(len(ids[k]), np.int64)
                for tree, book in zip(balls, books):
                    ball, entry, point, chosen = tree.owners(book)
                    own = np.empty(len(tree.order), np.int64)
                    size = tree.until[ball] - tree.first[ball]
                    own[ranges(tree.first[ball], size)] = np.repeat(entry, size)
                    own[point] = chosen
                    at = np.empty_like(own)
                    at[tree.order] = own
                    error[tree.order] += ((tree.values - book[own]) ** 2).sum(axis=1)
                    text = HEX[at] if text is None else np.char.add(text, HEX[at])
                yield pa.RecordBatch.from_arrays([ids[k].values, labels[k].values, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(code, "vec_id long, label string, code string, error long")


def encode(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks."""
    kept = usable(rows)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).toArrow()
    if not seeds.num_rows:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * PARTS
    vectors = seeds.column("vec").to_pylist()
    dim = len(vectors[0])
    if any(len(v) != dim for v in vectors):  # the first seed decides the length
        seeds = kept.where(F.size("vec") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).toArrow()
        vectors = seeds.column("vec").to_pylist()
    books = np.split(_whole(np.array(vectors, np.float64)), PARTS, axis=1)
    blocks = stored(trees(kept.where(F.size("vec") == dim), dim), "metric-trees")
    for _ in range(rounds):
        books = refined(blocks, books, dim)
    return stored(coded(blocks, books, dim), "vector-codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings after four rounds."""
    out, books = encode(table(spark, sf_dir, "embeddings"))
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return out.join(sums, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain rounds over all pairs of a part and an entry; distances are integers, exact in doubles."""
    cut = "{0}[p * (len({0}) // 4) + 1 : (p + 1) * (len({0}) // 4)]".format
    near = "CAST(min((x.xx + b.cc - 2 * list_inner_product(x.x, b.c)) * 256 + b.e) AS BIGINT)"
    steps = [
        """kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(embedding) % 4 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, {cut('v')} AS x, list_inner_product({cut('v')}, {cut('v')}) AS xx FROM kept, range(4) r(p))",
        "seeds AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v FROM (SELECT * FROM kept ORDER BY vec_id LIMIT 256))",
        f"b0 AS MATERIALIZED (SELECT p, e, {cut('v')} AS c, list_inner_product({cut('v')}, {cut('v')}) AS cc FROM seeds, range(4) r(p))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, any_value(x.x) AS x, {near} AS m FROM parts x JOIN b{k} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS c FROM a{k}, range(1, (SELECT max(len(x)) + 1 FROM parts)) r(i) GROUP BY p, m % 256, i)")
            steps.append(f"l{k} AS (SELECT p, e, list(c ORDER BY i) AS c FROM s{k} GROUP BY p, e)")
            steps.append(f"""b{k + 1} AS MATERIALIZED (
    SELECT p, e, c, list_inner_product(c, c) AS cc FROM (SELECT b.p, b.e, coalesce(l.c, b.c) AS c FROM b{k} b LEFT JOIN l{k} l ON b.p = l.p AND b.e = l.e))""")
    last = ROUNDS
    steps.append(f"codes AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{last} GROUP BY vec_id, label)")
    steps.append(f"flat AS (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{last})")
    steps.append("book AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM flat)")
    return "WITH " + ",\n".join(steps) + (
        "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, book")


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLE = {"op13_vector_codes": _sql()}
