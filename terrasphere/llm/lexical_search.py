"""Ranked lexical search by pipelined term partitioning.

Documents are read once, in blocks of at most BLOCK documents with their terms as posting lists; only terms that the
items may use are kept, by a bit field of fixed size. The terms are dealt to OWNERS owners, rare ones to the first, so that
each holds about the same number of postings. A bundle is a set of items before one block of documents: it carries a sparse
accumulator (document, score) for each item. Bundles go through the owners one after the other; at each they meet that
owner's postings of their block in a cogroup and add integer contributions. What is left after the last owner is
named and the best of all blocks are selected.

A block keeps only what can still be among its own best: a posting adds less than its term's weight times 1,000,000, so a
document whose score and all weights still to come stay below the k-th best score of the block is out for certain.
That drops no row that belongs into the result. Documents of a block are numbered by doc_id, which settles ties.

Terms are compared by 64-bit hash. NULL and empty texts have no terms; every row is a document, so repeated rows rank side by
side; rows without doc_id rank after others of their score; rows without item_id are no items, and different texts of
one item_id make up one item. An item that matches nothing gets no row, and neither do empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import bit_field, large_list, offsets_of, pieces, stored, table
from terrasphere.llm.words import ALNUM, word_hashes
from terrasphere.operators.ordered import top_k

BEST = 10
OWNERS = 4
BLOCK = 8192
BLOCK_POSTINGS = 2_000_000
BUNDLE = 256
FIELD_BITS = 24
CEILING = 1_000_000  # no posting adds more to a score than its weight times this
POSTINGS = "block long, term long, docs array<int>, tf array<int>, n array<int>, ids array<long>"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q): how often each item holds each term."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            doc, h, _, _ = word_hashes(batch.column("text"), ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(doc)), pa.array(h.view(np.int64))], ["item_id", "term"])

    rows = items.where("item_id IS NOT NULL").select("item_id", "text").distinct()
    return rows.mapInArrow(cut, f"item_id {kind}, term long").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def posting_blocks(docs: DataFrame, field: np.ndarray) -> DataFrame:
    """Posting lists (block, term, docs, tf, n) and, with a NULL term, one row per block: ids by number, n of every document.

    The number of a document is its place in its block by doc_id. The rows are written, so that blocks stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def block_rows(number: int, ids: list, counts: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)), np.int64)
        at = np.empty(len(ids), np.int64)
        at[order] = np.arange(len(ids))
        place = np.lexsort((at[doc], term))
        term, tf, doc = term[place], tf[place], doc[place]
        new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        off = np.r_[new, len(term), len(term)]  # the last list is empty: that of the block's own row
        n = np.r_[counts[doc], counts[order]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(new) + 1, number)), pa.array([*term[new].tolist(), None], pa.int64()), large_list(off, at[doc].astype(np.int32), pa.int32()), large_list(off, tf.astype(np.int32), pa.int32()),
             large_list(np.r_[off[:-1], len(n)], n.astype(np.int32), pa.int32()), large_list(np.r_[np.zeros(len(new) + 1, np.int64), len(ids)], [ids[k] for k in order], pa.int64())],
            ["block", "term", "docs", "tf", "n", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        made, ids, held, part = 0, [], [], 0

        def finished():
            counts, doc, term, tf = (np.concatenate([h[k] for h in held]) for k in range(4))
            return block_rows((part << 32) + made, ids, counts, doc, term, tf)

        for batch in pieces(batches, "text"):
            part = batch.column("part")[0].as_py()
            doc, h, _, _ = word_hashes(batch.column("text"), ALNUM)
            counts = np.bincount(doc, minlength=batch.num_rows)
            some = known[(h >> np.uint64(64 - FIELD_BITS)).astype(np.int64)] if len(h) else np.zeros(0, bool)
            doc, h = doc[some], h[some].view(np.int64)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[new, len(h)])
            doc, h = doc[new], h[new]
            names = batch.column("doc_id").to_pylist()
            for a in range(0, batch.num_rows, BLOCK):  # a batch of short texts may hold more than one block
                b = min(a + BLOCK, batch.num_rows)
                x, y = np.searchsorted(doc, (a, b))
                if held and (len(ids) + b - a > BLOCK or sum(len(t[1]) for t in held) + y - x > BLOCK_POSTINGS):
                    yield finished()
                    made, ids, held = made + 1, [], []
                held.append((counts[a:b], doc[x:y] - a + len(ids), h[x:y], tf[x:y]))
                ids.extend(names[a:b])
        if held:
            yield finished()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("part"))
    return stored(rows.mapInArrow(scan, POSTINGS), "posting-blocks")


def _owner(volumes: list, owners: int) -> Column:
    """Owner by the power of two of a term's documents, so that owners hold about the same number of postings."""
    total, run, out = sum(r.postings for r in volumes), 0, F.lit(owners - 1)
    for r in sorted(volumes, key=lambda r: -r.power):  # the rarest power is tested first
        out = F.when(F.col("power") <= r.power, F.lit(min(owners - 1, (total - run - r.postings) * owners // max(total, 1)))).otherwise(out)
        run += r.postings
    return out


def search(docs: DataFrame, items: DataFrame, best: int = BEST, owners: int = OWNERS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of every item."""
    spark = docs.sparkSession
    asked = stored(item_terms(items), "item-terms")
    postings = posting_blocks(docs, bit_field(asked, "term", FIELD_BITS))
    blocks = postings.where("term IS NULL")
    totals = blocks.select(F.inline(F.arrays_zip("n"))).agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    documents, length = totals.N, max(totals.L, 1)

    counted = postings.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    counted = counted.join(asked.select("term").distinct(), "term", "left_semi").withColumn("power", F.floor(F.log2("df")).cast("int"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * documents + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    counted = stored(counted.withColumn("w", weight).where("w > 0"), "term-weights")
    volumes = counted.groupBy("power").agg(F.sum("df").alias("postings")).collect()  # at most 64 rows
    owned = counted.select("term", "w", _owner(volumes, owners).alias("owner"))
    bundles = max(1, -(-asked.select("item_id").distinct().count() // BUNDLE))
    weighed = asked.join(owned, "term").select(
        F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int").alias("bundle"), "item_id", "term", "owner", (F.col("q") * F.col("w")).alias("weight"))
    weighed = stored(weighed, "item-weights")
    wanted = weighed.select("term", "bundle", "owner").distinct()
    carried = weighed.groupBy("bundle", "item_id").agg(F.collect_list(F.struct("owner", "term", "weight")).alias("terms"))
    carried = carried.select("bundle", "item_id", *[F.col(f"terms.{c}").alias(c + "s") for c in ("owner", "term", "weight")])
    kind = items.schema["item_id"].dataType.simpleString()
    bundle = f"block long, bundle int, item_id {kind}, owners array<int>, terms array<long>, weights array<long>, docs array<int>, scores array<long>"

    def visit(owner: int):
        last = owner == owners - 1

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.combine_chunks().sort_by("term")
            terms = right.column("term").to_numpy()
            lists = [right.column(c).combine_chunks() for c in ("docs", "tf", "n")]
            off = offsets_of(np.diff(lists[0].offsets.to_numpy())) if len(terms) else np.zeros(1, np.int64)
            at, tf, n = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            share = (1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // length))
            size = int(at.max(initial=-1)) + 1
            docs_, scores = [], []
            for mine, its, weights, had, sums in zip(*(_rows(left.column(c)) for c in ("owners", "terms", "weights", "docs", "scores"))):
                total = np.zeros(max(size, int(had.max(initial=-1)) + 1), np.int64)
                total[had] = sums
                here = mine == owner
                k = np.searchsorted(terms, its[here])
                for j, t, w in zip(k.tolist(), its[here].tolist(), weights[here].tolist()):
                    if j < len(terms) and terms[j] == t:
                        total[at[off[j] : off[j + 1]]] += w * share[off[j] : off[j + 1]]
                found = np.flatnonzero(total)
                if len(found) > best:
                    s = total[found]
                    bar = np.partition(s, len(s) - best)[len(s) - best]
                    found = found[s + int(weights[mine > owner].sum()) * CEILING >= bar]
                if last:
                    found = found[np.lexsort((found, -total[found]))[:best]]
                docs_.append(found.astype(np.int32))
                scores.append(total[found])
            per = offsets_of([len(x) for x in docs_])
            new = [large_list(per, np.concatenate(x) if x else [], t) for x, t in ((docs_, pa.int32()), (scores, pa.int64()))]
            return pa.Table.from_arrays([*(left.column(c) for c in ("block", "bundle", "item_id", "owners", "terms", "weights")), *new], ["block", "bundle", "item_id", "owners", "terms", "weights", "docs", "scores"])

        return meet

    none = [F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores")]
    state = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle")).join(carried, "bundle").select("block", "bundle", "item_id", "owners", "terms", "weights", *none)
    state = state.toDF(*state.columns)  # columns of their own: state and lists come from one table
    for owner in range(owners):
        lists = postings.join(wanted.where(F.col("owner") == owner).select("term", "bundle"), "term").select("block", "bundle", "term", "docs", "tf", "n")
        state = stored(state.groupBy("block", "bundle").cogroup(lists.groupBy("block", "bundle")).applyInArrow(visit(owner), bundle), f"bundles-{owner}")

    def name(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        lists = left.column("docs").combine_chunks()
        per = np.diff(lists.offsets.to_numpy())
        ids = right.column("ids").combine_chunks().flatten()
        return pa.Table.from_arrays(
            [left.column("item_id").combine_chunks().take(pa.array(np.repeat(np.arange(len(per)), per))), ids.take(lists.flatten()), left.column("scores").combine_chunks().flatten()], ["item_id", "doc_id", "score"])

    winners = state.where("size(docs) > 0").select("block", "item_id", "docs", "scores")
    named = winners.groupBy("block").cogroup(blocks.select("block", "ids").groupBy("block")).applyInArrow(
        lambda left, right: name(left, right) if left.num_rows else _no_rows(left), f"item_id {kind}, doc_id long, score long")
    ranked = top_k(named, ["item_id"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], best)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column, one array per row."""
    lists = column.combine_chunks()
    off = offsets_of(np.diff(lists.offsets.to_numpy()))
    return np.split(lists.flatten().to_numpy(), off[1:-1]) if len(lists) else []


def _no_rows(left: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([left.column("item_id"), pa.array([], pa.int64()), pa.array([], pa.int64())], ["item_id", "doc_id", "score"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH doc_words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_words GROUP BY doc_id, term
), sizes AS (
    SELECT doc_id, count(*) AS n FROM doc_words GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes
), dfs AS (
    SELECT term, count(*) AS df FROM tfs GROUP BY term
), item_words AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
    SELECT i.item_id, i.term, CAST(floor(1000 * ln((2 * c.docs + 2) / (2 * d.df + 1))) AS BIGINT) AS w
    FROM item_words i JOIN dfs d ON i.term = d.term CROSS JOIN corpus c
), scores AS (
    SELECT w.item_id, t.doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 75 + ((75 * s.n * c.docs) // c.len))))) AS BIGINT) AS score
    FROM weights w JOIN tfs t ON w.term = t.term JOIN sizes s ON s.doc_id = t.doc_id CROSS JOIN corpus c GROUP BY w.item_id, t.doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE = {"op12_lexical_search": SQL}
