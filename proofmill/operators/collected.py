"""Directories whose documents look collected rather than written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collected_directories(docs: DataFrame, least: int = 5, front_share: float = 0.8, skeleton_least: int = 20, skeleton_share: float = 0.2) -> DataFrame:
    """docs (dir, text) to (dir, files, frontmatter, repeated): directories that reach a share; two combining groupings."""
    shape = F.slice(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,3} (.+)$"), 1), F.lit(1), F.lit(6))
    one = docs.select("dir", F.when(F.size(shape) > 0, F.md5(F.array_join(shape, "\n"))).alias("shape"), F.startswith(F.ltrim(F.regexp_replace("text", r"^\s+", "")), F.lit("---")).alias("front"))
    per_shape = one.groupBy("dir", "shape").agg(F.count("*").alias("n"), F.count_if("front").alias("front"))
    repeated = F.sum(F.when(F.col("shape").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0))
    out = per_shape.groupBy("dir").agg(F.sum("n").alias("files"), F.sum("front").alias("frontmatter"), repeated.alias("repeated"))
    looks = (F.col("frontmatter") >= front_share * F.col("files")) | ((F.col("files") >= skeleton_least) & (F.col("repeated") >= skeleton_share * F.col("files")))
    return out.where((F.col("files") >= least) & looks)
