"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.session import materialize


def _hubs(pairs: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included; partial sums tame large stars."""
    return pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("hub"))


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``links`` (``a``, ``b``); root: the least reachable.

    Each round is written to the shared folder, so a lost executor costs one
    round.  Logarithmically many rounds; the driver sees two numbers a round.
    Null ends and loops link nothing.
    """
    links = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_hubs(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("hub").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.join(_hubs(large), "a")
        links = materialize(
            small.select(F.col("b").alias("a"), F.col("hub").alias("b"))
            .union(small.select("a", F.col("hub").alias("b")))
            .where("a <> b").distinct(),
            "links",
        )
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
