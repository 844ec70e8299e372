"""Checks that judge a file by itself, over a stream of new files (an extension: a whole audit reads everything each time).

Every micro-batch appends the findings of its files to one table. The stream's checkpoint knows which files were read, so a restart
goes on where it stopped; a batch that is run again replaces the rows that it wrote, by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import arithmetic, findings, overclaim
from ..operators.sentences import split_documents
from ..plans.audit import scan_findings
from ..sources import files

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_findings(raw: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """Findings of the scan and of the checks that need no other file."""
    listed = files.selected(raw, root)
    texts = files.read_texts(listed)
    lines = split_documents(texts.where("kind = 'text' and text is not null").select("rel", "text"))
    parts = [overclaim.check_overclaims(lines, strict), arithmetic.check_benchmarks(lines), arithmetic.check_seeds(lines)]
    return findings.union(raw.sparkSession, [scan_findings(listed, texts).where("line > 0 or file <> ''"), *parts])


def watch(spark: SparkSession, root: str, out: str, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """Start the stream over the files that are there and those that come; it stops when it has read all there are (availableNow)."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(FILES).load(root)

    def batch(rows: DataFrame, number: int) -> None:
        found = file_findings(rows, root, strict).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
