"""Answers of servers that are kept for a while: an expiring table of the latest answer to each request, fed from a log.

A log row is one attempt (key, version, taken, status_code and what came with it). Refusals, failures of the server and of the network say nothing about what was
asked for, so they are never kept and never push out an answer. An answer counts for `days`, and only for the version of the reader that asked. Nothing here opens
a connection: what is not kept is listed, to be asked by others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.citation import BLOCKED

DAYS = 7


def may_be_kept(status_code: Column) -> Column:
    """Whether an answer is about the thing asked for; 0 and null are failures of the network."""
    return F.coalesce((status_code > 0) & (status_code < 500) & ~status_code.isin(BLOCKED), F.lit(False))


def upsert(kept: DataFrame | None, log: DataFrame) -> DataFrame:
    """kept with the log's answers in it: of each key and version the latest that may be kept; of equal times that of the larger answer, so any order and repetition of
    batches gives the same table."""
    rows = log.where(may_be_kept(F.col("status_code")))
    rows = rows if kept is None else kept.select(*log.columns).unionByName(rows)
    rest = [c for c in log.columns if c not in ("key", "version")]
    latest = rows.groupBy("key", "version").agg(F.max(F.struct("taken", *(c for c in rest if c != "taken"))).alias("a"))
    return latest.select("key", "version", *(F.col(f"a.{c}").alias(c) for c in rest)).select(*log.columns)


def fresh(kept: DataFrame, version: str, now: Column, days: int = DAYS) -> DataFrame:
    """Rows of kept that still count at `now`."""
    return kept.where((F.col("version") == version) & (F.col("taken") > now - F.make_interval(days=F.lit(days))) & (F.col("taken") <= now))


def to_ask(requests: DataFrame, kept: DataFrame, version: str, now: Column, days: int = DAYS) -> DataFrame:
    """Distinct requests (key and others) that no kept answer serves."""
    return requests.dropDuplicates(["key"]).join(fresh(kept, version, now, days).select("key"), "key", "left_anti")
