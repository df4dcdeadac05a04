"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasphere.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) for every id in a link (a, b): component_id is the smallest id reachable.

    Each round lets every node choose the neighbour of smallest hash (or itself) and replaces the ends of
    all links by what they chose, so a constant share of the nodes goes in a round and about log(n) rounds
    suffice. Only links between different nodes are carried on; no group is gathered in one place.
    """
    e = cut_lineage(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                    .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    rounds = []
    while not e.isEmpty():
        both = e.select("a", F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id")).alias("n")).unionAll(
            e.select(F.col("b").alias("a"), F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id")).alias("n")))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        chosen = cut_lineage(both.groupBy("a").agg(F.min("n").alias("n")).select(F.col("a").alias("id"), F.least("n", own).getField("id").alias("to")))
        rounds.append(chosen)
        left = e.join(chosen.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
        e = left.join(chosen.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        e = cut_lineage(e.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not rounds:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    found = rounds[0]
    for chosen in rounds[1:]:
        later = chosen.select(F.col("id").alias("to"), F.col("to").alias("further"))
        found = found.join(later, "to", "left").select("id", F.coalesce("further", "to").alias("to"))
    found = cut_lineage(found)
    smallest = found.groupBy("to").agg(F.min("id").alias("component_id"))
    return found.join(smallest, "to").select("id", "component_id")
