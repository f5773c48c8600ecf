"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import written


def component_labels(links: DataFrame) -> DataFrame:
    """id, component: the least id that links (a, b), read both ways, lead to.

    Each round every id takes the least label beside it and then that label's own label, so a chain of n
    links takes about log n rounds; its result is a table in the checkpoint folder. Only labels that the round before made less are
    told to those beside them, as the others were told before; they are a table too, so that Spark knows when they are few.
    """
    beside = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(beside.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")))
    news = labels
    while True:
        least = beside.join(news.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        hooked = labels.join(least, "id", "left").select("id", F.col("component").alias("before"), F.least("component", "least").alias("over"))
        beyond = labels.select(F.col("id").alias("over"), F.col("component").alias("beyond"))
        moved = written(hooked.join(beyond, "over", "left").select("id", "before", F.least("over", F.coalesce("beyond", "over")).alias("component")))
        labels = moved.select("id", "component")
        news = written(moved.where("component <> before").select("id", "component"))
        if news.isEmpty():
            return labels
