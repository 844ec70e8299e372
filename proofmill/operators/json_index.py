"""JSON files of any shape in the value index: numbers by key path, aggregates of numeric lists, lengths of other lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_tokens
from ..sources.readers import json_values
from .values import AGGREGATES, _list, _row, numeric_aggregates

VALUES = "file string, path string, value double, numbers array<double>, length int, keys array<string>, cut boolean"


def walk_json(texts: DataFrame) -> DataFrame:
    """texts (file, text) to one row for each value; a row without path carries the file's keys and whether the walk was cut. Unreadable files give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found, keys, cut = json_values(text or "")
                except ValueError:
                    continue
                rows += [(file, p, v, x, n, None, None) for p, v, x, n in found] + [(file, None, None, None, None, sorted(set(keys)), cut)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.string()), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "path", "value", "numbers", "length", "keys", "cut"])

    return texts.select("file", "text").mapInArrow(run, VALUES)


def index_json(walked: DataFrame) -> DataFrame:
    """Index rows; the words of a value are those of all keys on its path."""
    cells = walked.where("numbers is not null").select("file", F.col("path").alias("header"), F.explode(F.col("numbers").cast("array<string>")).alias("raw"))
    words = reduce(lambda w, k: w.when(F.col("what") == k, _list(AGGREGATES[k])), list(AGGREGATES)[1:], F.when(F.col("what") == "count", _list(AGGREGATES["count"])))
    path = name_tokens("path")
    return (
        _row(walked.where("value is not null"), F.col("value"), F.col("path"), path, _list([]))
        .unionByName(_row(numeric_aggregates(cells), F.col("value"), F.concat_ws(" ", "header", "what"), name_tokens("header"), words))
        .unionByName(_row(walked.where("path is not null and value is null and numbers is null"), F.col("length"), F.concat("path", F.lit(" length")), path, _list(["count", "number"])))
    )


def json_info(walked: DataFrame) -> DataFrame:
    """What a sentence may call each file, as file_info gives for tables."""
    name = F.element_at(F.split("file", "/"), -1)
    return walked.where("path is null").select("file", F.lower(name).alias("name"), name_tokens(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), F.col("keys").alias("headers"))
