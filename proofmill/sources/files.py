"""A folder of documents as DataFrames: listing, classification, readers, and what could not be read.

Files are listed and read by Spark's binaryFile source, so any store will do; each file is decoded where it is read. Names
that begin with a dot or underscore are not listed (a deviation: the file system's listing drops them).
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import translate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import readers

# What is read, and folders that never hold documents.
TEXT, DATA, BIB = [".md", ".markdown", ".txt", ".tex", ".rst", ".ipynb", ".docx"], [".csv", ".json"], [".bib", ".bbl"]
SKIPPED_FOLDERS = [".git", ".venv", "venv", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".idea", ".vscode"]
MOST_BYTES = 30_000_000
#: The ignore file of a folder.
IGNORE = ".auditignore"


def walk_order(rel: Column) -> Column:
    """Sorts like a walk that lists a folder's files before its sub-folders."""
    parts = F.split(rel, "/")
    return F.concat(F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(F.lit("1"), p)), "/"), F.when(F.size(parts) > 1, F.lit("/")).otherwise(F.lit("")), F.lit("0"), F.element_at(parts, -1))


def excluded(rel: Column, patterns: list[str]) -> Column:
    """Whether the path, its last name or one of its folders matches a glob."""
    out = F.lit(False)
    for p in patterns:
        rx = translate(p.rstrip("/")).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "")
        out = out | rel.rlike(f"^(?:{rx})$") | F.element_at(F.split(rel, "/"), -1).rlike(f"^(?:{rx})$") | rel.rlike(f"^(?:{rx})/")
    return out


def ignored(spark: SparkSession, root: str) -> list[str]:
    """Patterns of the folder's ignore file, one a line; blank lines and those that begin with # are none."""
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(root.rstrip("/") or "/", IGNORE)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    try:
        text = bytes(stream.readNBytes(MOST_BYTES)).decode("utf-8", "replace")
    finally:
        stream.close()
    return [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]


def list_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """rel, ord, kind (text, data, bib), length, content of every file that an extension selects; what `exclude` and the folder's ignore file name is left out."""
    exclude = [*(exclude or []), *ignored(spark, root)]
    return selected(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, exclude)


def selected(raw: DataFrame, root: str, exclude: list[str] | None = None) -> DataFrame:
    """The same for rows of the binaryFile source, whether of a folder or of a stream of its new files."""
    spark = raw.sparkSession
    # The root as the file system names it: what all listed paths begin with.
    jvm = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm).toString().rstrip("/")
    rel = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(base.replace("file:///", "file:/")) + 2), F.length("path"))
    out = raw.withColumn("rel", rel)
    ext = F.lower(F.concat(F.lit("."), F.element_at(F.split(F.element_at(F.split("rel", "/"), -1), r"\."), -1)))
    kind = F.when(ext.isin(TEXT), "text").when(ext.isin(DATA), "data").when(ext.isin(BIB), "bib")
    skipped = F.exists(F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1), lambda d: d.isin(SKIPPED_FOLDERS) | F.startswith(d, F.lit(".")))
    return out.select("rel", walk_order(F.col("rel")).alias("ord"), kind.alias("kind"), "length", "content").where(F.col("kind").isNotNull() & ~skipped & ~excluded(F.col("rel"), exclude or []))


def read_texts(files: DataFrame) -> DataFrame:
    """Text and bibliography files: rel, ord, kind, text, error, unread (parts that were not read), silence (why a container has no prose)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = list(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True))
            made = [readers.read(rel, content) for rel, content in files]
            silence = [readers.why_silent(rel, content) if text is not None and not text.strip() else None for (rel, content), (text, _, _) in zip(files, made, strict=True)]
            yield pa.record_batch([*b.columns[:3], pa.array([t for t, _, _ in made], pa.string()), pa.array([e for _, e, _ in made], pa.string()), pa.array([p for _, _, p in made], pa.list_(pa.string())), pa.array(silence, pa.string())], ["rel", "ord", "kind", "text", "error", "unread", "silence"])

    rows = files.where((F.col("kind") != "data") & (F.col("length") <= MOST_BYTES)).select("rel", "ord", "kind", "content")
    return rows.mapInArrow(run, "rel string, ord string, kind string, text string, error string, unread array<string>, silence string")


def read_bibliography(texts: DataFrame) -> DataFrame:
    """Entries of .bib and .bbl texts: rel, ord, key, fields, line, unread."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rel, order, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                made = readers.bbl_entries(text) if rel.lower().endswith(".bbl") else [(*e, None) for e in readers.bib_entries(text)]
                rows += [(rel, order, key, list(fields.items()), line, unread) for key, fields, line, unread in made]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["rel", "ord", "key", "fields", "line", "unread"])

    return texts.where("kind = 'bib' and text is not null").select("rel", "ord", "text").mapInArrow(run, "rel string, ord string, key string, fields map<string,string>, line int, unread string")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every cell as text."""
    return spark.read.option("header", "true").option("multiLine", "true").option("encoding", "UTF-8").csv(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries (label, value, tolerance, how) as text, repeated labels kept; from CSV or JSON."""
    if path.lower().endswith(".csv"):
        raw = read_csv(spark, path)
        have = {c.strip().lower(): c for c in raw.columns}
        label = next((have[c] for c in ("label", "claim", "key") if c in have), None)
        if "value" not in have or not label:
            raise ValueError(f"a registry needs a value and a label, claim or key column; columns: {', '.join(sorted(have))}")
        col = lambda c: F.trim(F.col(f"`{have[c]}`")) if c in have else F.lit(None).cast("string")
        return raw.select(F.trim(F.col(f"`{label}`")).alias("label"), col("value").alias("value"), col("tolerance").alias("tolerance"), F.coalesce(col("how"), F.lit("")).alias("how")).where("label <> ''")
    import json

    def pairs(found: list[tuple[str, object]]) -> list:
        return found

    made = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()), object_pairs_hook=pairs)
    rows = []
    for label, v in made:
        entry = dict(v) if isinstance(v, list) else {"value": v}
        text = lambda x: None if x is None or isinstance(x, bool) else str(x)
        rows.append((label, text(entry.get("value")), text(entry.get("tolerance")), str(entry.get("how", ""))))
    return spark.createDataFrame(rows, "label string, value string, tolerance string, how string")
