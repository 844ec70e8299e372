"""The value index: what data tables hold, as one long table of values with the words that describe them.

Columns: value, file, where, stem, col, label, agg (arrays of tokens). Aggregates of all columns of a table come
from one unpivot and one grouping (partial aggregation map-side); cells are the unpivoted rows themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import name_tokens, number

# Aggregates and the words that name them.
AGGREGATES = {
    "count": ["count", "number", "total"], "mean": ["mean", "average", "avg"], "median": ["median"], "min": ["min", "minimum", "lowest", "worst"], "max": ["max", "maximum", "highest", "best", "worst"],
    "sum": ["sum", "total"], "std": ["std", "sd", "deviation"], "share": ["share", "rate", "percent", "coverage"], "count true": ["count"],
    "mean x100": ["mean", "percent"], "median x100": ["median", "percent"], "min x100": ["min", "percent"], "max x100": ["max", "percent"],
}
MOST_CELL_ROWS, MOST_CATEGORIES = 3_000, 30
#: Slices that the bracket of a median is cut into.
SLICES = 4_096


def _list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def unpivot(table: DataFrame, file: str, row_key: Column | None = None) -> DataFrame:
    """file, header, raw, v: one row for each non-empty cell of every column, as text and as a number; with label if row_key."""
    pair = lambda c, kind: F.struct(F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("raw"), _typed_number(F.col(f"`{c}`"), kind).alias("v"))
    pairs = F.array(*(pair(f.name, f.dataType) for f in table.schema.fields))
    out = table.select(F.lit(file).alias("file"), *([row_key.alias("label")] if row_key is not None else []), F.explode(pairs).alias("cell"))
    return out.select("file", *(["label"] if row_key is not None else []), "cell.header", "cell.raw", "cell.v").where("raw is not null and raw <> ''")


def _typed_number(x: Column, kind: T.DataType) -> Column:
    """What `number` reads from the cell's text, without the text where the type allows."""
    if isinstance(kind, T.BooleanType):
        return x.cast("double")
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.DoubleType)):
        v = x.cast("double")
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    return number(x.cast("string"))


def _number(cells: DataFrame) -> Column:
    return F.col("v") if "v" in cells.columns else number("raw")


def medians(cells: DataFrame, v: Column) -> DataFrame:
    """Exact median of each column (file, header, median), without all its values in one place.

    A sketch brackets the median within a thousandth of the ranks; below the bracket values are counted, and within it equal values are one row. The bracket is cut into
    SLICES of equal width, whose counts say in which of them the middle ranks are: only those slices' values are ordered, each slice on its own.
    """
    of = ["file", "header"]
    rows = cells.select(*of, v.alias("x")).where("x is not null")
    bracket = rows.groupBy(*of).agg(F.count("*").alias("n"), F.percentile_approx("x", [0.4995, 0.5005], 10_000).alias("b"))
    # A row for each column of the tables.
    near = rows.join(F.broadcast(bracket), of).where(F.col("x") <= F.col("b")[1]).groupBy(*of, "n", "b", F.when(F.col("x") >= F.col("b")[0], F.col("x")).alias("x")).agg(F.count("*").alias("c"))
    lo, hi = F.col("b")[0], F.col("b")[1]
    place = F.when(F.col("x").isNull(), -1).when(hi <= lo, 0).otherwise(F.least(F.floor((F.col("x") - lo) / (hi - lo) * SLICES), F.lit(SLICES - 1)))
    sliced = near.select(*of, "n", "x", "c", place.alias("slice"))
    upto = lambda by: F.sum("c").over(Window.partitionBy(*of).orderBy(by))
    counts = sliced.groupBy(*of, "n", "slice").agg(F.sum("c").alias("c")).withColumn("upto", upto("slice"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    within = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    middle = counts.where(within(low) | within(high)).select(*of, "slice", (F.col("upto") - F.col("c")).alias("before"))
    ranked = sliced.join(F.broadcast(middle), [*of, "slice"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*of, "slice").orderBy("x")))
    at = lambda rank: F.max(F.when(within(rank), F.col("x")))
    return ranked.groupBy(*of).agg(at(low).alias("low"), at(high).alias("high")).select(*of, ((F.col("low") + F.col("high")) / 2).alias("median"))


def column_types(cells: DataFrame) -> DataFrame:
    """Per column: cells, cells that are numbers, distinct cells, and whether nine tenths are numbers."""
    return cells.groupBy("file", "header").agg(F.count("*").alias("cells"), F.count(_number(cells)).alias("numeric_cells"), F.count_distinct("raw").alias("distinct_cells")).withColumn("is_numeric", F.col("numeric_cells") >= 0.9 * F.col("cells"))


def numeric_aggregates(cells: DataFrame) -> DataFrame:
    """Per numeric column: every aggregate as a row (file, header, what, value)."""
    v = _number(cells)
    binary, unit = F.bool_and(v.isin(0.0, 1.0)), F.bool_and(v.between(0.0, 1.0))
    stats = cells.groupBy("file", "header").agg(
        F.count("*").alias("cells"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.stddev_samp(v).alias("std"), binary.alias("binary"), unit.alias("unit")
    ).where((F.col("n") >= 0.9 * F.col("cells")) & (F.col("n") > 0)).join(medians(cells, v), ["file", "header"])
    share = F.col("unit") & ~F.col("binary")
    rows = {
        "count": F.col("n").cast("double"), "mean": F.col("mean"), "median": F.col("median"), "min": F.col("min"), "max": F.col("max"), "sum": F.col("sum"), "std": F.when(F.col("n") > 1, F.col("std")),
        "share": F.when(F.col("binary"), 100 * F.col("mean")), "count true": F.when(F.col("binary"), F.col("sum")),
        **{f"{k} x100": F.when(share, 100 * F.col(k)) for k in ("mean", "median", "min", "max")},
    }
    long = F.array(*(F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in rows.items()))
    return stats.select("file", "header", F.explode(long).alias("r")).select("file", "header", "r.what", "r.value").where("value is not null")


def category_counts(cells: DataFrame, most: int = MOST_CATEGORIES) -> DataFrame:
    """Text columns with at most `most` different values: (file, header, raw, n)."""
    kinds = column_types(cells).where(~F.col("is_numeric") & (F.col("distinct_cells") <= most)).select("file", "header")
    return cells.join(kinds, ["file", "header"], "left_semi").groupBy("file", "header", "raw").agg(F.count("*").alias("n"))


def _row(df: DataFrame, value: Column, where: Column, col: Column, agg: Column, label: Column | None = None) -> DataFrame:
    stem = name_tokens(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""))
    return df.select(value.cast("double").alias("value"), "file", where.alias("where"), stem.alias("stem"), col.alias("col"), (label if label is not None else _list([])).alias("label"), agg.alias("agg"))


def index_table(table: DataFrame, file: str, label_col: str | None = None, cells: bool | None = None) -> DataFrame:
    """All indexed values of one table: row count, aggregates, category counts and, for small tables, cells."""
    long = unpivot(table, file)
    words = reduce(lambda w, k: w.when(F.col("what") == k, _list(AGGREGATES[k])), list(AGGREGATES)[1:], F.when(F.col("what") == "count", _list(AGGREGATES["count"])))
    header = name_tokens("header")
    parts = [
        _row(table.agg(F.count("*").alias("n")).where("n > 0").withColumn("file", F.lit(file)), F.col("n"), F.lit("row count"), _list([]), _list(["row", "rows", "count", "total"])),
        _row(numeric_aggregates(long), F.col("value"), F.concat_ws(" ", "header", "what"), header, words),
        _row(column_types(long).where(~F.col("is_numeric")), F.col("distinct_cells"), F.concat("header", F.lit(" distinct")), header, _list(["distinct", "unique", "number"])),
        _row(category_counts(long), F.col("n"), F.concat("header", F.lit("="), "raw", F.lit(" count")), header, _list(["count"]), name_tokens("raw")),
    ]
    if cells if cells is not None else len(table.limit(MOST_CELL_ROWS + 1).select(F.lit(1)).collect()) <= MOST_CELL_ROWS:
        label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit("")
        numeric = column_types(long).where("is_numeric").select("file", "header")
        each = unpivot(table, file, F.coalesce(label, F.lit(""))).join(numeric, ["file", "header"], "left_semi").where("v is not null")
        parts.append(_row(each, F.col("v"), F.concat("header", F.lit(" ["), "label", F.lit("]")), header, _list([]), name_tokens("label")))
    return reduce(DataFrame.unionByName, parts)


def file_info(table: DataFrame, file: str) -> DataFrame:
    """What a sentence may call the table: one row (file, name, stem, headers)."""
    name = file.rsplit("/", 1)[-1].lower()
    one = table.sparkSession.range(1)
    return one.select(F.lit(file).alias("file"), F.lit(name).alias("name"), name_tokens(F.lit(file.rsplit("/", 1)[-1].rsplit(".", 1)[0])).alias("stem"), F.array(*map(F.lit, table.columns)).alias("headers"))


def cell_number(x: object) -> float | None:
    """A single data value as a finite number, as `number` reads a column."""
    if isinstance(x, bool):
        return float(x)
    try:
        v = float(str(x).strip().replace(",", "")) if str(x).strip().lower() not in ("true", "false") else float(str(x).strip().lower() == "true")
    except ValueError:
        return None
    return v if v == v and abs(v) != float("inf") else None
