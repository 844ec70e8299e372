"""Language identification with rank-order n-gram profiles.

A profile is the list of the most frequent character 1- to 3-grams of a language, words being padded with
a mark of their ends. A document's own list is compared with each profile by the out-of-place distance: the
sum over the document's n-grams of the difference of ranks, the length of a profile for an n-gram that it
lacks. The nearest profile wins; the score is 1 - (distance to the winner / distance to the next language), or
1 - winner's distance / its largest possible value with a single language.

Profiles are learned from distinct texts, so copies of a text, however many, weigh no more than one. A language with more than
`sample` of them is learned from those with the smallest hashes; every language that has a text is learned, whatever its share.

Defined results: a null text or one without any letter is `und` with score 0, as is every text when
nothing could be learned. Texts of any length are counted whole; they are read in blocks, and n-grams run across the blocks' bounds. Ties go to
the smaller n-gram and to the alphabetically first language. A repeated row is predicted like any other. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, held_out

#: Characters counted at once.
BLOCK = 1 << 18
#: Languages whose table of cuts is sent to all tasks; more are joined by shuffling.
MOST_BROADCAST = 100_000
#: Marks the ends of words; no letter, and not 0, so that n-grams of different lengths differ.
GAP = 1
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text (up to three code points of 21 bits, GAP between words) in ascending order, and their counts."""
    text, parts = text.lower(), []
    last = np.array([GAP], np.int64)  # the end of what was read: with it, n-grams of up to three signs run across blocks
    for at in range(0, len(text), BLOCK):
        code = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.where(_is_letter()[code], code, GAP)
        x = np.concatenate([last, code, np.array([GAP][: at + BLOCK >= len(text)], np.int64)])
        x = x[(x > GAP) | np.concatenate([[True], x[:-1] > GAP])]  # one mark between words
        one, two = x[len(last) :], x[len(last) - 1 : -1] << 21 | x[len(last) :]
        start = max(len(last), 2)
        three = x[start - 2 : -2] << 42 | x[start - 1 : -1] << 21 | x[start:]
        made = np.concatenate([one[one > GAP], two, three[x[start - 1 : -1] > GAP]])
        parts.append(np.unique(made, return_counts=True))
        last = x[-2:]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The learned lists; small, so it travels with the task: `size` n-grams for each of a bounded number of languages."""

    def __init__(self, lists: dict[str, list[int]], size: int):
        self.langs = sorted(lists)
        self.size = size
        self.grams = np.unique(np.array([g for x in lists.values() for g in x], np.int64)) if lists else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, np.array(lists[lang], np.int64))] = np.arange(len(lists[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        own = _top(*gram_counts(text), self.size)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == own), at, len(self.grams))
        theirs = self.ranks[:, at]
        far = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(1)
        best = int(far.argmin())
        rest = np.delete(far, best)
        other = rest.min() if len(rest) else self.size * len(own)
        return self.langs[best], float(1 - far[best] / other) if other else 0.0


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400, sample: int = 4000) -> Profiles:
    """Profiles from rows with text and language: about `sample` distinct texts for each language (their number is estimated), all where it has fewer."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and length(text) > 0")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # Where to cut each language's hashes; the hash is uniform over distinct texts.
    cut = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select("lang", (F.lit(float(1 << 30)) * sample / F.greatest("n", F.lit(sample))).alias("most")).cache()
    few = cut.count() <= MOST_BROADCAST
    kept = hashed.join(F.broadcast(cut) if few else cut, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("most"))
    kept = kept.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in made.items():
                grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    counts = kept.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    cut.unpersist()
    lists: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "rank", "gram").collect()):
        lists.setdefault(r.lang, []).append(r.gram)
    return Profiles(lists, size)


def predict_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, held_out, lang_pred, score: one row per input row."""
    bounded_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [profiles.predict(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string"))
    return rows.mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(spark: SparkSession, docs: DataFrame, **options: int) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    return predict_language(docs, learn_profiles(docs.where(~held_out(F.col("doc_id"))), **options))
