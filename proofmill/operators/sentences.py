"""Documents to sentences with line numbers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import extract_numbers
from ..functions.text import ABBREVIATIONS, DOT, strip_markdown, strip_tex, tokens
from .tables import dealt, written

#: Characters up to which a document is read by one task, and lines of a piece of a longer one.
LONG, CHUNK = 1 << 20, 10_000
#: Characters whose sentences a worker holds before it hands them on, and bytes of the Arrow batches that reach it.
HELD, BATCH_BYTES = 1 << 20, 8 << 20
SENTENCE = "rel string, line int, seq int, sentence string"
#: text.BREAK with its stop, which a search finds faster than what stands behind it.
_BREAK = re.compile(r"[.!?]\s+(?=[A-Z(\[\"'])")
_ABBREVIATED = [(a, a.replace(".", DOT)) for a in ABBREVIATIONS]
_RULE, _HEADING, _LINE = re.compile(r"\|?[\s:|-]+\|?"), re.compile(r"#{1,6}\s"), re.compile(r"[-=]{3,}")
_MARKER = re.compile(r"^([-*+]|\d+[.)])\s+")
#: How a line ends in an abbreviation, whole or by its latter word, and what opens a sentence.
_ABBREVIATIONS, _LATTER = tuple(ABBREVIATIONS), {a.split(" ", 1)[1] for a in ABBREVIATIONS if " " in a}
_OPENS = tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ([\"'")


def _kind(line: str) -> str:
    if line.startswith("|") and line.count("|") >= 2:
        return "rule" if _RULE.fullmatch(line) else "row"
    if line.startswith("#") and _HEADING.match(line):
        return "heading"
    return "prose" if line and not _LINE.fullmatch(line) else "gap"


def units(cleaned: str) -> list[tuple[int, str, list[int]]]:
    """(first line, text, offsets where its further lines begin): table rows and headings alone, paragraphs joined."""
    lines = [(n, s.strip()) for n, s in enumerate(cleaned.split("\n"), 1)]
    out = []
    for kind, run in groupby(lines, key=lambda x: _kind(x[1])):
        if kind == "row":
            out += [(n, s, []) for n, s in run]
        elif kind == "heading":
            out += [(n, s.lstrip("#").strip(), []) for n, s in run]
        elif kind == "prose":
            parts = [(n, _MARKER.sub("", s)) for n, s in run]
            offsets, at = [], 0
            for _, s in parts[:-1]:
                at += len(s) + 1
                offsets.append(at)
            out.append((parts[0][0], " ".join(s for _, s in parts), offsets))
    return out


def unit_sentences(line: int, text: str, offsets: list[int]) -> list[tuple[int, str]]:
    """(line, sentence) of a unit, in order."""
    out, begin = [], 0
    for a, protected in _ABBREVIATED:
        if a in text:
            text = text.replace(a, protected)
    for end, after in [*((m.start() + 1, m.end()) for m in _BREAK.finditer(text)), (len(text), len(text))]:
        sentence = text[begin:end].replace(DOT, ".").strip()
        if sentence:
            out.append((line + bisect_right(offsets, begin), sentence))
        begin = after
    return out


def sentences_of(cleaned: str) -> list[tuple[int, str]]:
    """(line, sentence) of a cleaned text, in order."""
    return [found for unit in units(cleaned) for found in unit_sentences(*unit)]


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))


def _whole(docs: DataFrame) -> DataFrame:
    """Sentences of documents that one task reads one by one; what a worker holds is bounded by HELD characters and a document, whatever an Arrow batch has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for b in batches:
            # A batch is bounded in bytes, so its texts may be held; only what is made of them may not.
            for rel, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                made += [(rel, line, seq, s) for seq, (line, s) in enumerate(sentences_of(text))]
                held += len(text) + 100
                if held > HELD:
                    yield _table(made, rel=pa.string(), line=pa.int32(), seq=pa.int32(), sentence=pa.string())
                    made, held = [], 0
        yield _table(made, rel=pa.string(), line=pa.int32(), seq=pa.int32(), sentence=pa.string())

    # Texts are long and the default bounds rows only.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.mapInArrow(run, SENTENCE)


def _segments(docs: DataFrame, chunk: int) -> DataFrame:
    """Pieces of `chunk` lines, dealt over tasks, to (rel, piece, n, first, last, s, lens): rows, headings, and paragraphs as far as they go in the piece, from line n.

    A paragraph is cut where a sentence ends with a line in any case, so one of any length is many rows; `first` and `last` say that it may go on in the piece before and after.
    lens has the lengths of its lines.
    """
    # Outer: the filter that a plain explode implies would clean the text a second time.
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / chunk).cast("int")), lambda i: F.slice("lines", i * chunk + 1, F.lit(chunk)))
    pieces = docs.where("text is not null").select("rel", F.split("text", "\n").alias("lines")).select("rel", F.posexplode_outer(slices).alias("piece", "lines")).where("piece is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for b in batches:
            for rel, piece, lines in zip(*(c.to_pylist() for c in b.columns), strict=True):
                joins = ended = False
                for n, raw in enumerate(lines, piece * chunk + 1):
                    text = raw.strip()
                    kind = _kind(text)
                    if kind == "prose":
                        text = _MARKER.sub("", text)
                        if joins and not (ended and text.startswith(_OPENS)):
                            made[-1][5].append(text)
                        else:
                            made.append([rel, piece, n, n == piece * chunk + 1, False, [text]])
                        # An abbreviation may begin on the line before.
                        ended = text.endswith((".", "!", "?")) and not text.endswith(_ABBREVIATIONS) and text not in _LATTER
                    elif kind in ("row", "heading"):
                        made.append([rel, piece, n, False, False, [text.lstrip("#").strip() if kind == "heading" else text]])
                    joins = kind == "prose"
                    held += len(raw) + 100
                if joins:
                    made[-1][4] = True
                if held > HELD:
                    yield segments(made)
                    made, held = [], 0
        yield segments(made)

    def segments(made: list[list]) -> pa.RecordBatch:
        rows = [(*m[:5], " ".join(m[5]), list(map(len, m[5]))) for m in made]
        return _table(rows, rel=pa.string(), piece=pa.int32(), n=pa.int32(), first=pa.bool_(), last=pa.bool_(), s=pa.string(), lens=pa.list_(pa.int32()))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return dealt(pieces, "rel", "piece").mapInArrow(run, "rel string, piece int, n int, first boolean, last boolean, s string, lens array<int>")


def paragraph_heads(edges: DataFrame) -> DataFrame:
    """edges (rel, piece, n, first, last), the segments at the edges of pieces, with head: the line where the paragraph begins that each belongs to.

    Gaps and islands over a row or two for each piece, without texts.
    """
    order = Window.partitionBy("rel").orderBy("n")
    linked = F.coalesce(F.col("first") & F.lag("last").over(order) & (F.lag("piece").over(order) == F.col("piece") - 1), F.lit(False))
    return edges.withColumn("begun", F.when(~linked, F.col("n"))).select("rel", "n", F.last("begun", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("head"))


def _in_pieces(docs: DataFrame, chunk: int) -> DataFrame:
    """Sentences of documents whose lines are dealt over tasks."""
    # Read by its edges and by its texts: documents are cleaned and cut once.
    parts = written(_segments(docs, chunk), "segments")
    edges = parts.where("first or last")
    heads = paragraph_heads(edges.select("rel", "piece", "n", "first", "last"))
    joined = edges.select("rel", "n", "s", "lens").join(heads, ["rel", "n"]).groupBy("rel", F.col("head").alias("n")).agg(F.sort_array(F.collect_list(F.struct("n", "s", "lens"))).alias("parts"))
    units = parts.where("not (first or last)").select("rel", "n", "s", "lens").unionByName(joined.select("rel", "n", F.array_join("parts.s", " ").alias("s"), F.flatten("parts.lens").alias("lens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for rel, n, text, lens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = unit_sentences(n, text, list(accumulate(x + 1 for x in lens[:-1])))
                made.append((rel, n, [line for line, _ in found], [s for _, s in found]))
            yield _table(made, rel=pa.string(), n=pa.int32(), lines=pa.list_(pa.int32()), found=pa.list_(pa.string()))

    # Read by its sizes and by its sentences.
    made = written(units.mapInArrow(run, "rel string, n int, lines array<int>, found array<string>").withColumn("piece", F.floor((F.col("n") - 1) / chunk)), "units")
    sizes = made.groupBy("rel", "piece").agg(F.sum(F.size("found")).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("rel").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(F.size("found")).over(Window.partitionBy("rel", "piece").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = made.withColumn("inside", inside).join(sizes.select("rel", "piece", before.alias("before")), ["rel", "piece"]).withColumn("begin", F.col("before") + F.col("inside"))
    each = placed.select("rel", "begin", F.posexplode_outer(F.arrays_zip("lines", "found")).alias("i", "at")).where("i is not null")
    return each.select("rel", F.col("at.lines").alias("line"), (F.col("begin") + F.col("i")).cast("int").alias("seq"), F.col("at.found").alias("sentence"))


def _cleaned(docs: DataFrame) -> DataFrame:
    return docs.select("rel", F.when(F.lower("rel").endswith(".tex"), strip_tex("text")).otherwise(strip_markdown("text")).alias("text"))


def split_documents(docs: DataFrame, long: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """docs (rel, text) to (rel, line, seq, sentence); cleaned as TeX or Markdown by the name, in built-in functions. Documents are dealt over tasks first: all that reads their sentences runs where they are.

    With `long`, documents of more characters are dealt over tasks in pieces of `chunk` lines; without, each is read by one task. Texts are read once more for it,
    so callers that know sizes (a listing of files has them) ask for it only where there are such documents.
    """
    docs = dealt(docs.select("rel", "text"), "rel", "text")
    if long is None:
        return _whole(_cleaned(docs))
    small = F.coalesce(F.length("text"), F.lit(0)) <= long
    return _whole(_cleaned(docs.where(small))).unionByName(_in_pieces(_cleaned(docs.where(~small)), chunk))


def extract_claims(sentences: DataFrame) -> DataFrame:
    """Sentences that state a number, with their numbers and tokens and a stable id."""
    with_digit = sentences.where(F.col("sentence").rlike(r"\d"))
    found = with_digit.withColumn("nums", extract_numbers("sentence")).where(F.size("nums") > 0)
    return found.withColumn("tokens", tokens("sentence")).withColumn("claim_id", F.xxhash64("rel", "line", "seq"))
