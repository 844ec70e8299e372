"""Identifiers in text, who saw them first, and what records say about them."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How identifiers are written.
ARXIV = r"(?i)(?:arxiv[:.\s/]*|arxiv\.org/(?:abs|pdf|html)/)(\d{4}\.\d{4,5})"
DOI = r"\b(10\.\d{4,9}/[^\s\"'<>{}|\\^`\]]+)"
URL = r"https?://[^\s\"'<>{}|\\^`\])]+"


def _exploded(lines: DataFrame, kind: str, order: int, pattern: str, group: int, cut: str) -> DataFrame:
    found = F.posexplode(F.regexp_extract_all("text", F.lit(pattern), group)).alias("pos", "ident")
    out = lines.where(F.col("text").rlike(pattern)).select("rel", "file_ord", "line", found)
    return out.select("rel", "file_ord", "line", "pos", F.lit(kind).alias("kind"), F.lit(order).alias("kind_ord"), F.regexp_replace("ident", cut, "").alias("ident"))


def find_mentions(docs: DataFrame) -> DataFrame:
    """docs (rel, file_ord, text) to every (kind, ident, rel, file_ord, line, kind_ord, pos); arXiv and DOI links are no URLs."""
    lines = docs.select("rel", "file_ord", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    parts = [_exploded(lines, "arxiv", 0, ARXIV, 1, "$^"), _exploded(lines, "doi", 1, DOI, 1, r"[.,;:)]+$"), _exploded(lines, "url", 2, URL, 0, r"[.,;:]+$")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where(~((F.col("kind") == "url") & (F.contains("ident", F.lit("arxiv.org")) | F.contains("ident", F.lit("doi.org")))))


def first_seen(mentions: DataFrame, order: list[str]) -> DataFrame:
    """One row for each identifier: the first by the given order (a map-side minimum, no window over a hot identifier)."""
    rest = [c for c in mentions.columns if c not in ("kind", "ident", *order)]
    return mentions.groupBy("kind", "ident").agg(F.min(F.struct(*order, *rest)).alias("m")).select("kind", "ident", "m.*")


def capped(mentions: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first `most` identifiers of each kind in first-seen order."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    return mentions.withColumn("place", place).where(F.col("place") <= most).drop("place")


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition begins with one ASCII letter, that letter, and those that decompose into several."""
    made = {c: d for c in map(chr, range(0x80, 0x10000)) if (d := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()).isalpha()}
    one = {c: d for c, d in made.items() if len(d) == 1}
    return "".join(one), "".join(one.values()), {c: d for c, d in made.items() if "\ufb00" <= c <= "\ufb06"}


def normal_name(x: Column) -> Column:
    """Names as lower-case ASCII letters and blanks: TeX accents go, letters are decomposed, combining marks and all else go."""
    letters, plain, several = _folding()
    bare = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), several.items(), F.regexp_replace(x, r"\\[`'^\"~=.]\{?(\w)\}?", "$1"))
    return F.trim(F.regexp_replace(F.lower(F.translate(bare, letters, plain)), "[^a-z ]", ""))


def surnames(authors: Column) -> Column:
    """Last names of a bibliography's author field, without "others"."""
    names = F.filter(F.transform(F.split(F.regexp_replace(authors, r"\s+", " "), r"\s+and\s+"), lambda a: F.trim(a)), lambda a: (a != "") & ~F.lower(a).isin("others", "et al."))
    last = F.transform(names, lambda a: F.when(F.contains(a, F.lit(",")), F.substring_index(a, ",", 1)).otherwise(F.element_at(F.split(a, " "), -1)))
    return F.transform(last, lambda n: F.element_at(F.split(normal_name(F.regexp_replace(n, "[{}]", "")), " "), -1))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of three or more letters."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(normal_name(t), F.lit("[a-z]{3,}"), 0))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(F.array_union(words(a), words(b))), F.lit(1))


def look_up(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """Mentions with their record's status: resolves, is dead, or could not be checked."""
    out = mentions.join(records, ["kind", "ident"], "left")
    status = F.col("status_code")
    return out.withColumn("status", F.when(status.between(200, 399), "VERIFIED").when(status.isin(404, 410), "FLAGGED").otherwise("UNVERIFIABLE"))
