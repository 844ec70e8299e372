"""The one output table of all checks, its ranking and its summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "check string, status string, file string, line int, message string, evidence string, extra map<string,string>"
VERIFIED, FLAGGED, UNVERIFIABLE = "VERIFIED", "FLAGGED", "UNVERIFIABLE"
CHECKS = ["scan", "registry", "benchmark", "seeds", "source", "citation", "support", "consistency", "overclaim"]
COLUMNS = ["check", "status", "file", "line", "message", "evidence", "extra"]


def findings(df: DataFrame, check: str, status: Column | str, file: Column | str, line: Column | str | int, message: Column, evidence: Column | None = None, extra: Column | None = None) -> DataFrame:
    """Rows of the findings schema from any frame."""
    status = F.lit(status) if isinstance(status, str) and status in (VERIFIED, FLAGGED, UNVERIFIABLE) else status
    line = F.lit(line) if isinstance(line, int) else F.col(line) if isinstance(line, str) else line
    nothing = F.create_map().cast("map<string,string>")
    return df.select(F.lit(check).alias("check"), status.alias("status") if isinstance(status, Column) else F.col(status).alias("status"), (F.col(file) if isinstance(file, str) else file).alias("file"), line.cast("int").alias("line"), message.alias("message"), F.coalesce(evidence if evidence is not None else F.lit(""), F.lit("")).alias("evidence"), (extra if extra is not None else nothing).alias("extra"))


def union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], SCHEMA))


def status_rank(status: str = "status") -> Column:
    return F.when(F.col(status) == FLAGGED, 0).when(F.col(status) == UNVERIFIABLE, 1).otherwise(2)


def priority(check: str = "check", status: str = "status", message: str = "message") -> Column:
    """What to show first: lower comes first; only flagged rows have a place."""
    c, m = F.col(check), F.lower(message)
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(m, F.lit(w)) for w in words))
    # The order of the checks.
    ladder = [
        (c == "scan", 5), (c == "consistency", 10), (c == "benchmark", 11), (c == "seeds", 12), ((c == "citation") & has("authors differ", "title differs", "does not match"), 13),
        ((c == "registry") & has("the text says"), 14), (c == "source", 15), ((c == "support") & has("contradicted"), 16), ((c == "citation") & has("url is dead", "not found", "does not resolve"), 30),
        ((c == "registry") & has("missing from"), 31), ((c == "overclaim") & has("(negated)"), 60), (c == "overclaim", 50),
    ]
    rank = reduce(lambda w, x: w.when(*x), ladder[1:], F.when(*ladder[0])).otherwise(35)
    return F.when(F.col(status) == FLAGGED, rank).otherwise(1000)


def top(found: DataFrame, n: int) -> DataFrame:
    """The n flagged rows to look at first (one take-ordered step, no full sort)."""
    return found.where(F.col("status") == FLAGGED).withColumn("priority", priority()).orderBy("priority", "check", "file", "line", "message").limit(n)


def listed(found: DataFrame, limit: int = 200) -> DataFrame:
    """Report order within each check, at most `limit` rows of it, with how many were left out."""
    of_check = Window.partitionBy("check")
    ranked = found.withColumn("place", F.row_number().over(of_check.orderBy(status_rank(), "file", "line", "message", "evidence")))
    totals = found.groupBy("check").agg(F.count("*").alias("total"))
    return ranked.where(F.col("place") <= limit).join(F.broadcast(totals), "check").withColumn("trimmed", F.greatest(F.col("total") - limit, F.lit(0)))


def summary(found: DataFrame, ran: list[str]) -> DataFrame:
    """Rows per check and status; checks that ran and found nothing stand at zero."""
    counts = found.groupBy("check").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in (VERIFIED, FLAGGED, UNVERIFIABLE)))
    names = found.sparkSession.createDataFrame([(c,) for c in ran], "check string")
    return names.join(counts, "check", "full").na.fill(0)


def totals(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in (VERIFIED, FLAGGED, UNVERIFIABLE)))
