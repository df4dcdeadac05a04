"""Removal of lines that many documents share, with DataFrame functions only.

Texts are split at line feeds. A line's key is the line without blanks at its ends and with A-Z in lower case; keys of
at least `least` code points are hashed to 128 bits and exploded, one row for each line. Documents are counted per
hash: the keys of a row are made distinct before they are exploded, so the count is of documents and the sums are
formed before the shuffle. Keys found in at least `documents` of them lose their lines except in the document of smallest
doc_id. Positions of lost lines go back to their text, which is put together from the stretches between them.

A key that a large share of all documents hold would be one task of a join. The keys that hold more than 1/HOT_KEYS of
all repeated lines are at most HOT_KEYS; they are sent to every task, and only the others are joined by shuffle.

NULL and empty texts are one empty line. Every row is a document. Rows of equal doc_id keep or lose a line together:
where the smallest doc_id of a key has several rows, all of them keep it. Rows without doc_id come after all others: they
lose what a row with doc_id holds and nothing to each other. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import stored, table

LEAST = 10
DOCUMENTS = 2
HOT_KEYS = 1 << 14
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line as it is compared; lower() equals the translation where all letters are ASCII, and is faster."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def long_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_key, keys): position (from 0) and hash of every line whose key is long enough, by document."""
    keys = F.transform(F.col("lines"), lambda line, i: F.struct(i.alias("at"), line_key(line).alias("key")))
    hashed = lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(11), x["key"]).alias("h2"))
    rows = docs.select("doc_id", "text_key", keys.alias("keys"))
    return rows.select("doc_id", "text_key", F.transform(F.filter("keys", lambda x: F.char_length(x["key"]) >= least), hashed).alias("keys"))


def dropped_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, text_key, at): the lines that go; `lines` as long_lines() gives them, stored."""
    once = F.array_distinct(F.transform("keys", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    counted = lines.select("doc_id", F.inline(once)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    repeated = stored(counted.where((F.col("n") >= documents) & F.col("first").isNotNull()), "repeated-lines")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most HOT_KEYS keys can hold more than 1/HOT_KEYS of the total each
    hot = F.col("n") > total // HOT_KEYS if total > HOT_KEYS * documents else F.lit(False)
    each = lines.select("doc_id", "text_key", F.inline("keys"))
    found = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))
    key, stay = ["h1", "h2"], ["doc_id", "text_key", "at"]
    common = F.broadcast(repeated.where(hot).select(*key, "first"))
    rare = repeated.where(~hot).select(*key, "first")
    few = each.join(F.broadcast(repeated.where(hot).select(*key)), key, "left_anti").join(rare, key).where(found).select(*stay)
    return each.join(common, key).where(found).select(*stay).unionByName(few)


def without_repeated_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document without the lines that go."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), lines_of("text").alias("lines"))
    lines = stored(long_lines(rows, least), "long-lines")
    # rows that are equal in doc_id and text share their positions
    gone = dropped_lines(lines, documents).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "gone")
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    # stretches between lost lines: before the first, between neighbours, after the last
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x + 1))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    stretches = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: x["a"] < x["b"])
    rest = F.flatten(F.transform(stretches, lambda x: F.slice("lines", x["a"] + 1, x["b"] - x["a"])))
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return met.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_gone).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(rest), "\n").alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document of smaller doc_id holds too."""
    out = without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
    SELECT k.*, s.key IS NOT NULL AND k.doc_id > s.first AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLE = {"op11_line_dedup": SQL}
