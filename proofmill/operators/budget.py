"""Who may ask a model under a budget of calls, and what was used.

Replies that are kept are free. The others are served in their order while the budget holds: each may ask if what all before it cost, and what it may
cost itself at most, is within it. That is one running sum over the whole order, so the order is dealt in ranges over tasks, each
range is summed up on its own, and the ranges' sums, a row for each task, are carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

CACHED, ASKED, BEYOND = "cached", "asked", "beyond"


def running_sum(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """rows with before: the sum of the column over all rows ahead in the order, which no two rows share."""
    dealt = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "in-order")
    sums = dealt.groupBy("part").agg(F.sum(column).alias("own"))
    ahead = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("part", ahead("own", Window.orderBy("part")).alias("carried"))  # a row for each task
    local = dealt.withColumn("local", ahead(column, Window.partitionBy("part").orderBy(*order)))
    return local.join(F.broadcast(carried), "part").withColumn("before", F.col("carried") + F.col("local")).drop("part", "local", "carried")


def allocate(claims: DataFrame, replies: DataFrame, budget: int, most: int = 2) -> DataFrame:
    """claims (key, ord, cost) with state and before: cached, asked or beyond the budget; claims of one key share the first one's call.

    cost is what a claim's calls came to, `most` what must be left for one to begin.
    """
    first = claims.groupBy("key").agg(F.min_by(F.struct("ord", "cost"), F.struct("ord", "cost")).alias("f")).select("key", "f.ord", "f.cost")
    known = first.join(replies.select("key").distinct().withColumn("kept", F.lit(True)), "key", "left")
    free = F.coalesce("kept", F.lit(False))
    summed = running_sum(known.withColumn("paid", F.when(free, 0).otherwise(F.col("cost"))), ["ord", "key"], "paid")
    state = F.when(free, CACHED).when(F.col("before") + most <= budget, ASKED).otherwise(BEYOND)
    return claims.join(summed.select("key", state.alias("state"), "before"), "key")


def usage(calls: DataFrame) -> DataFrame:
    """calls (model, input_tokens, output_tokens), one row each, summed up by model; unknown counts are none."""
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c)
    return calls.groupBy("model").agg(F.count("*").alias("calls"), total("input_tokens"), total("output_tokens"))
