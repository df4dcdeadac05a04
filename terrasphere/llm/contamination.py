"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of its words. A window is the set of its word trigrams; containing it means containing
all of them, so one necessary token is enough as prefix: its rarest, by occurrences over all documents. Documents are
read twice. The first reading counts the trigrams that stand in any window; the second carries each place of a prefix
token, with the words around it, to the windows of that token, where length and position are bounded by the words
there are and the whole window is compared word by word. Before the joins documents only need a bit field of fixed
size, so benchmark tables of any size work; a prefix token in very many documents is a skewed join key, which
adaptive execution splits.

NULL texts have no words; an item without words or without item_id is no item; repeated items count once; documents
with equal doc_id are told apart by their texts; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import offsets_of, pieces, ranges, stored, table
from terrasphere.llm.words import ALNUM, gram_hash, word_hashes

WINDOW = 10
TOKEN_WORDS = 3
FIELD_BITS = 24


def _tokens(h: np.ndarray, n: int) -> np.ndarray:
    return gram_hash(h, n).view(np.int64)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (words, items) of all items; words are hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            doc, h, _, _ = word_hashes(batch.column("text"), ALNUM)
            n = np.bincount(doc, minlength=batch.num_rows)
            size, many = np.minimum(n, window), np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
            owner = np.repeat(np.arange(batch.num_rows), many)
            first = ranges(np.cumsum(n) - n, many)
            values = h[ranges(first, size[owner])].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(owner)), pa.ListArray.from_arrays(pa.array(offsets_of(size[owner]), pa.int32()), pa.array(values))], ["item", "words"])

    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item string, words array<long>")
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


def window_tokens(windows: DataFrame) -> DataFrame:
    """(words, items, token, at): every token of every window and its place there."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_tokens(np.array(w, np.int64).view(np.uint64), min(TOKEN_WORDS, len(w))) for w in batch.column("words").to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(offsets_of([len(x) for x in out]), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("words"), batch.column("items"), lists], ["words", "items", "tokens"])

    rows = windows.mapInArrow(hashes, "words array<long>, items array<string>, tokens array<long>")
    return rows.select("words", "items", F.posexplode("tokens").alias("at", "token"))


def _field(tokens: DataFrame) -> np.ndarray:
    """Bit field of fixed size over the leading bits of the tokens."""
    cells = tokens.select(F.shiftrightunsigned("token", 64 - FIELD_BITS).alias("c")).distinct().toPandas()["c"].to_numpy(np.int64)
    field = np.zeros(1 << FIELD_BITS, bool)
    field[cells] = True
    return np.packbits(field)


def _lengths(windows: DataFrame) -> list[int]:
    """Token lengths in use: the full one, and shorter ones for items of fewer words."""
    return sorted({min(TOKEN_WORDS, r.n) for r in windows.select(F.least(F.size("words"), F.lit(TOKEN_WORDS)).alias("n")).distinct().collect()})


def _places(h: np.ndarray, doc: np.ndarray, field: np.ndarray, lengths: list[int]):
    """Places of words whose token may be in the field, and the tokens."""
    for n in lengths:
        t = gram_hash(h, n)
        if len(t):
            at = np.flatnonzero(field[(t >> np.uint64(64 - FIELD_BITS)).astype(np.int64)])
            at = at[doc[at] == doc[at + n - 1]]
            yield at, t[at].view(np.int64)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items) of every document: its words inside occurring windows, and whose
    windows they are; text_key is xxhash64(text)."""
    spark = docs.sparkSession
    tokens = stored(window_tokens(item_windows(items, window)), "window-tokens")
    lengths = _lengths(tokens)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    all_field = spark.sparkContext.broadcast(_field(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(all_field.value).view(bool)
        for batch in pieces(batches, "text"):
            doc, h, _, _ = word_hashes(batch.column("text"), ALNUM)
            for _, t in _places(h, doc, field, lengths):
                t, n = np.unique(t, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["token", "n"])

    seen = texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("p")
    prefix = tokens.join(seen, "token", "left").groupBy("words").agg(rarest, F.first("items").alias("items"))
    # a window whose rarest token occurs nowhere occurs nowhere
    prefix = stored(prefix.where("p.n > 0").select("words", "items", "p.token", "p.at"), "window-prefixes")
    prefix_field = spark.sparkContext.broadcast(_field(prefix))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(prefix_field.value).view(bool)
        for batch in pieces(batches, "text"):
            doc, h, _, _ = word_hashes(batch.column("text"), ALNUM)
            n = np.bincount(doc, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            found = [*_places(h, doc, field, lengths)]
            at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
            t = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(at, kind="stable")
            at, t = at[order], t[order]
            low = np.maximum(at - window + 1, first[doc[at]])
            high = np.minimum(at + window, (first + n)[doc[at]])
            around = pa.ListArray.from_arrays(pa.array(offsets_of(high - low), pa.int32()), pa.array(h[ranges(low, high - low)].view(np.int64)))
            place = pa.StructArray.from_arrays([pa.array(t), pa.array(at - first[doc[at]]), pa.array(at - low), around], ["token", "pos", "back", "around"])
            per = offsets_of(np.bincount(doc[at], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n), pa.ListArray.from_arrays(pa.array(per, pa.int32()), place)], ["doc_id", "text_key", "n_words", "places"])

    read = stored(texts.mapInArrow(find, "doc_id long, text_key long, n_words long, places array<struct<token: long, pos: long, back: long, around: array<long>>>"), "benchmark-places")
    place = read.where("size(places) > 0").select("doc_id", "text_key", F.inline("places")).distinct()
    met = place.join(prefix, "token").where("back >= at").where("slice(around, int(back - at + 1), size(words)) = words")
    met = met.select("doc_id", "text_key", (F.col("pos") - F.col("at")).alias("start"), F.size("words").alias("len"), "items")
    hit = met.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    hit = hit.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), covered.cast("long").alias("n_hit"), "items")
    whole = read.select("doc_id", "text_key", "n_words").join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    none = F.array().cast("array<string>")
    return whole.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.array_sort(F.coalesce("items", none)).alias("items"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a benchmark window, and the items met."""
    out = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op3_contamination": op3_contamination}
ORACLE: dict[str, str] = {}
