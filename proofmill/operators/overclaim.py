"""Absolute wording for a person to review: one flagged row for each match of a category that its gate lets through."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import FLAGGED, findings

# Categories and their words.
CATEGORIES = {
    "priority claim": r"\bfirst\b",
    "exclusivity claim": r"\b(?:only\s+(?:known|way|publisher|method|tool)|only\s+one\s+(?:that|which|to|who))\b",
    "universal negative": r"\b(?:nobody|no\s?one|no other|none of)\b",
    "proof language": r"\b(?:proven|proves?|proof|prove)\b",
    "absolute": r"\b(?:always|never)\b",
    "superiority claim": r"\b(?:beats?|outperforms?|surpass(?:es)?|best|state[- ]of[- ]the[- ]art|sota)\b",
    "novelty claim": r"\b(?:novel|groundbreaking|revolutionary|unprecedented|breakthrough)\b",
    "guarantee": r"\b(?:guarantee[sd]?|guaranteed)\b",
    "certainty word": r"\b(?:clearly|obviously|undeniably|definitely|certainly)\b",
    "universal claim": r"\b(?:everyone|everybody|all\s+users|any\s+model)\b",
}
STRICT = {"universal quantifier (noisy)": r"\b(?:every|all)\b"}
#: Categories whose words count wherever they stand.
UNGATED = ["exclusivity claim", "universal negative", "absolute", "novelty claim", "guarantee", "certainty word", "universal claim"]
# Constructions that make "first" a claim, "best" absolute, and words that negate what follows.
_BETWEEN = r"(?:\s+(?!the\b|a\b|an\b|of\b|for\b|on\b|to\b)\w+){0,2}\s+"
_PRIORITY = re.compile(
    r"(?:we\s+are|this\s+is)\s+the\s+first|the\s+first\s+(?:to|that|which)\b|the\s+first" + _BETWEEN + r"(?:(?:work|paper|study|method|model|approach|system)\b|attempt\s+to\b)|for\s+the\s+first\s+time|(?:are|is|was|were)\s+the\s+first\s+to\b", re.I
)
_UNIVERSAL = re.compile(r"\s+(?:all|every|any|everything|everyone)(?:\s+existing)?\b", re.I)
_ABSOLUTE = re.compile(r"(?:\s+\w+){0,3}\s+ever\b|\s+(?:in\s+the\s+world|of\s+all(?:\s+time)?|known)\b", re.I)
_MODEST = re.compile(r"\s+(?:judgment|judgement|practices|effort|of\s+our\s+knowledge)\b", re.I)
_NEGATED = re.compile(r"(?:\bnot|\bno|n't|\bnever|\bwithout|\bnor)\s+(?:(?:be|been|is|are|was|were|yet|really|always|necessarily|fully|the|a|an)\s+)*$", re.I)


def _first(before: str, word: str, after: str, whole: str) -> bool:
    opens = not before.strip() and re.match(r"\s*,", after)
    return not opens and not re.match(r"\s+\d", after) and _PRIORITY.search(whole) is not None


def _superior(before: str, word: str, after: str, whole: str) -> bool:
    if word.lower() == "best":
        return not re.search(r"\bat\s+$", before, re.I) and not _MODEST.match(after) and _ABSOLUTE.match(after) is not None
    return word.lower().startswith(("beat", "outperform", "surpass")) and _UNIVERSAL.match(after) is not None


def _no_heading(before: str, word: str, after: str, whole: str) -> bool:
    return re.fullmatch(r"\s*proof\s*[.:]?\s*", whole, re.I) is None


GATES: dict[str, Callable[[str, str, str, str], bool]] = {"priority claim": _first, "superiority claim": _superior, "proof language": _no_heading}
MATCH = "array<struct<category:string,word:string,negated:boolean,snippet:string>>"


def overclaims(sentence: str, categories: dict[str, re.Pattern]) -> list[dict]:
    out = []
    for category, pattern in categories.items():
        for m in pattern.finditer(sentence):
            before, after = sentence[: m.start()], sentence[m.end() :]
            if category not in GATES or GATES[category](before, m[0], after, sentence):
                snippet = sentence if len(sentence) <= 160 else sentence[max(0, m.start() - 70) : m.end() + 70]
                out.append({"category": category, "word": m[0], "negated": _NEGATED.search(before) is not None, "snippet": snippet.strip()})
    return out


def cue(strict: bool = False) -> str:
    """One pattern that every match contains a match of: sentences without it never leave the JVM."""
    return "(?U)(?i)" + "|".join([*CATEGORIES.values(), *(STRICT.values() if strict else ())])


def find_overclaims(sentences: DataFrame, strict: bool = False) -> DataFrame:
    """sentences with one more row (category, word, negated, snippet) for each match."""
    table = {k: re.compile(v, re.I) for k, v in (CATEGORIES | (STRICT if strict else {})).items()}

    @F.pandas_udf(MATCH)
    def matches(s: pd.Series) -> pd.Series:
        return s.map(lambda x: overclaims(x, table))

    # Not to be moved: a filter on the result would be pushed below it, and the text read once for the filter and once for the result.
    found = sentences.where(F.col("sentence").rlike(cue(strict))).withColumn("found", matches.asNondeterministic()("sentence"))
    return found.select(*sentences.columns, F.explode("found").alias("m")).select(*sentences.columns, "m.*")


def word_count(text: Column, category: str) -> Column:
    """Matches of an ungated category in a text, in the JVM."""
    return F.regexp_count(text, F.lit("(?U)(?i)" + CATEGORIES[category]))


def check_overclaims(sentences: DataFrame, strict: bool = False) -> DataFrame:
    found = find_overclaims(sentences, strict)
    message = F.concat("category", F.lit(": '"), "word", F.lit("'"), F.when(F.col("negated"), " (negated)").otherwise(""))
    return findings(found, "overclaim", FLAGGED, "rel", "line", message, F.col("snippet"))
