"""Numbers that a sentence states, with kind and printed precision (Arrow batches: contexts need match positions)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import NOT_NUMBERS

NUMBER = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("raw", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("decimals", T.IntegerType()), T.StructField("den", T.DoubleType())])
# Nouns that make a small integer a count.
COUNT_NOUNS = frozenset("""
rows row items item models model files file samples sample users user cards card checkpoints checkpoint test tests
papers paper runs run cells cell evaluations evaluation benchmarks benchmark publishers publisher schemes scheme
families family features feature examples example queries query documents document pages page images image tokens token
steps step participants respondents customers requests errors bugs claims citations references sources datasets dataset
classes class layers layer parameters trials trial folds fold seeds seed
""".split())
# Words after which a plain number names a part of the document.
_STRUCTURE = re.compile(r"(?:section|sec\.?|figure|fig\.?|table|eq\.?|equation|page|pp\.?|day|step|chapter|appendix|version|v|no\.?|number|item|line|lines|part|phase|week)\s*$", re.I)
_LITERAL = re.compile(r"(?<![\w.$/\-])([-−+±]?)(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(\s?(?:%|pp\b|percentage points?\b|percent\b|×|x\b))?(?!\w)")
_RATIO = re.compile(r"(?<![\w.])(\d+(?:,\d{3})*)\s*(?:of|/)\s*(\d+(?:,\d{3})*)(?![\w/])")
_RANGE = re.compile(r"(?<=[\d%])\s*(?:--|–|—)\s*(?=\d)")
_SCRUB = re.compile(NOT_NUMBERS)
_NOUN = re.compile(r"\s+([A-Za-z]+)")
#: What a match of NOT_NUMBERS holds, but for a bracket, an address's "://" and "www.".
_DOTTED = re.compile(r"\d[.\-]\d")
_ARROW = pa.struct([("value", pa.float64()), ("raw", pa.string()), ("kind", pa.string()), ("decimals", pa.int32()), ("den", pa.float64())])
_KINDS = {"%": "pct", "percent": "pct", "x": "x", "×": "x"}


def _value(digits: str) -> float:
    return float(digits.replace(",", ""))


def _is_structure(text: str, start: int, end: int, value: float, decimals: int) -> bool:
    """Whether a plain number is a year, a label or too small to be a claim."""
    if _STRUCTURE.search(text, max(0, start - 14), start):
        return True
    if decimals:
        return False
    noun = _NOUN.match(text, end)
    return 1900 <= value <= 2100 or (abs(value) < 10 and (noun.group(1).lower() if noun else "") not in COUNT_NOUNS)


def numbers(sentence: str | None) -> list[dict]:
    """Ratios first, then every other number outside them, each in order of appearance."""
    text = sentence or ""
    # Each pattern is run only on texts that hold what its matches must.
    if "[" in text or "://" in text or _DOTTED.search(text) or "www." in text.lower():
        text = _SCRUB.sub(" ", text)
    if "--" in text or "–" in text or "—" in text:
        text = _RANGE.sub(" to ", text)
    ratios = [(m, _value(m[1]), _value(m[2])) for m in _RATIO.finditer(text)] if "of" in text or "/" in text else []
    ratios = [(m, a, b) for m, a, b in ratios if b >= 2 and a <= b * 1.0001 + 1e-9]
    out = [{"value": a, "raw": m[0], "kind": "ratio", "decimals": 0, "den": b} for m, a, b in ratios]
    covered = {i for m, _, _ in ratios for i in range(*m.span())}
    for m in _LITERAL.finditer(text):
        if m.start() in covered:
            continue
        sign, digits, unit = m[1], m[2], (m[3] or "").strip().lower()
        kind = "pp" if unit.startswith(("pp", "percentage")) else _KINDS.get(unit, "plain")
        value, decimals = (-1 if sign in ("-", "−") and sign else 1) * _value(digits), len(digits.partition(".")[2])
        if kind != "plain" or not _is_structure(text, m.start(), m.end(), value, decimals):
            out.append({"value": value, "raw": m[0].strip(), "kind": kind, "decimals": decimals, "den": None})
    return out


@F.arrow_udf(T.ArrayType(NUMBER))
def extract_numbers(sentence: pa.Array) -> pa.Array:
    return pa.array([numbers(s) for s in sentence.to_pylist()], pa.list_(_ARROW))


# Not to be moved: a filter on the result would be pushed below it, and the text read once for the filter and once for the result.
extract_numbers = extract_numbers.asNondeterministic()
