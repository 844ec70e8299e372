"""Recorded answers of servers to sources: metadata and text by tiers, without a connection.

responses is a table (ident, what, status_code, content, truncated): what was asked for an identifier and what came back. `what` is atom or abs
(arXiv's two descriptions), crossref, html (a paper's full text), pdf, or page (a web page). Each answer is read where it lies; the tiers of an
identifier are then one grouping: full text that passes its self-check, else an abstract, else metadata, else nothing, with a note of why.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fulltext import html_text, normal_form
from ..operators.source_index import self_check, token_bags

RESPONSES = "ident string, what string, status_code int, content binary, truncated boolean"
ANSWER = "ident string, what string, title string, abstract string, authors array<string>, year int, body string, refs string, plain string, closed boolean, note string"
#: Answers longer than this are not used.
MOST_BYTES = 15_000_000
_ATOM = "{http://www.w3.org/2005/Atom}"


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def _surnames(names: list[str]) -> list[str]:
    return [n.split()[-1] for x in names if (n := normal_form(x).strip())]


def _year(date: str) -> int:
    return int(date[:4]) if date[:4].isdigit() else 0


class _Head(HTMLParser):
    """Title, named meta tags and the block quoted as abstract of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, list[str]] = {}
        self.text: dict[str, list[str]] = {"title": [], "abstract": []}
        self.inside: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        of = {k: v or "" for k, v in attrs}
        if tag == "meta" and of.get("name"):
            self.meta.setdefault(of["name"], []).append(_line(of.get("content")))
        if tag == "title" or (tag == "blockquote" and of.get("class", "").startswith("abstract")):
            self.inside = "title" if tag == "title" else "abstract"

    def handle_endtag(self, tag: str) -> None:
        self.inside = None if tag in ("title", "blockquote") else self.inside

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.text[self.inside].append(data)


def _head(html: str) -> _Head:
    p = _Head()
    p.feed(html)
    p.close()
    return p


def read_atom(content: bytes) -> dict | None:
    """The first entry of an Atom feed."""
    entry = ElementTree.fromstring(content).find(f"{_ATOM}entry")
    if entry is None:
        return None
    text = lambda tag: _line(entry.findtext(f"{_ATOM}{tag}"))
    return {"title": text("title"), "abstract": text("summary"), "authors": _surnames([a.findtext(f"{_ATOM}name") or "" for a in entry.iter(f"{_ATOM}author")]), "year": _year(text("published"))}


def read_abs(content: bytes) -> dict | None:
    """An abstract page, by its citation tags."""
    p = _head(content.decode("utf-8", "replace"))
    one = lambda name: (p.meta.get(name) or [""])[0]
    abstract = re.sub(r"^Abstract:\s*", "", _line(" ".join(p.text["abstract"])))
    found = {"title": one("citation_title"), "abstract": abstract, "authors": _surnames([a.split(",")[0] for a in p.meta.get("citation_author", [])]), "year": _year(one("citation_date"))}
    return found if found["title"] else None


def read_crossref(content: bytes) -> dict | None:
    """A work of Crossref's interface."""
    work = json.loads(content)["message"]
    parts = ((work.get("issued") or {}).get("date-parts") or [[0]])[0]
    return {"title": _line((work.get("title") or [""])[0]), "abstract": _line(re.sub("<[^>]+>", " ", work.get("abstract") or "")), "authors": _surnames([a["family"] for a in work.get("author", []) if a.get("family")]), "year": int((parts or [0])[0] or 0)}


def read_markup(content: bytes, page: bool) -> dict:
    """Text of a paper's HTML or of a web page, and whether the end of the document is there."""
    html = content.decode("utf-8", "replace")
    body, refs = html_text(html)
    return {"title": _line(" ".join(_head(html).text["title"])) if page else "", "body": body, "refs": refs, "plain": body if page else html_text(html, formulas=False)[0], "closed": html.rstrip().lower().endswith("</html>")}


def read_answer(what: str, status: int | None, content: bytes | None, truncated: bool | None) -> dict:
    """One answer as columns of ANSWER; a failure is a note and never raises."""
    if status != 200 or not content:
        return {"note": f"{what} unavailable (status {status or 0})"}
    if truncated or len(content) > MOST_BYTES:
        return {"note": f"{what} larger than the download limit, so it was not used"}
    readers = {"atom": read_atom, "abs": read_abs, "crossref": read_crossref, "html": lambda c: read_markup(c, False), "page": lambda c: read_markup(c, True)}
    if what not in readers:
        return {"note": f"{what} not read"}
    try:
        return readers[what](content) or {"note": f"{what} describes nothing"}
    except (ValueError, KeyError, TypeError, IndexError, ElementTree.ParseError) as e:
        return {"note": f"{what} could not be read: {type(e).__name__}"}


def read_responses(responses: DataFrame) -> DataFrame:
    """Rows of ANSWER."""
    names = [c.strip().split()[0] for c in ANSWER.split(", ")]
    s, strings = pa.string(), pa.list_(pa.string())
    kinds = [s, s, s, s, strings, pa.int32(), s, s, s, pa.bool_(), s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"ident": i, "what": w} | read_answer(w, code, content, cut) for i, w, code, content, cut in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return responses.select("ident", "what", "status_code", "content", "truncated").mapInArrow(run, ANSWER)


def assemble(responses: DataFrame) -> DataFrame:
    """Sources (ident, title, authors, year, trusted, body, refs, abstract, tier, note): the best tier of each identifier."""
    answers = read_responses(responses)
    rank = F.when(F.col("what") == "atom", 0).when(F.col("what") == "abs", 1).when(F.col("what") == "crossref", 2).when(F.col("what") == "page", 3)
    described, full = F.col("title").isNotNull() & rank.isNotNull(), F.col("body").isNotNull()
    per = answers.groupBy("ident").agg(
        F.min_by(F.struct("title", "abstract", "authors", "year"), F.when(described, rank)).alias("m"), F.max_by(F.struct("body", "refs", "plain", "closed", (F.col("what") == "page").alias("web")), F.when(full, F.when(F.col("what") == "html", 2).otherwise(1))).alias("f"),
        F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("note"),
    )
    rows = per.select("ident", "m.title", "m.authors", "m.year", "m.abstract", "f.body", "f.refs", "f.plain", "f.closed", "f.web", "note")
    checked = self_check(rows)
    trusted = F.col("body").isNotNull() & (F.size("why") == 0)
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    tier = F.when(trusted & F.col("web"), "web").when(trusted, "html").when(some("abstract"), "abstract").when(some("title") | (F.size("authors") > 0), "metadata").otherwise("none")
    note = F.concat_ws("; ", F.nullif("note", F.lit("")), F.when(F.col("body").isNotNull() & ~trusted, F.concat(F.lit("text failed its self-check: "), F.array_join("why", "; "))))
    return checked.select("ident", "title", "authors", "year", trusted.alias("trusted"), F.when(trusted, F.col("body")).alias("body"), F.when(trusted, F.col("refs")).alias("refs"), "abstract", tier.alias("tier"), note.alias("note"))


def citation_records(responses: DataFrame) -> DataFrame:
    """Records (kind, ident, status_code, title, authors) as the citation check takes them, from answers that describe an identifier."""
    codes = responses.groupBy("ident").agg(F.min_by("status_code", F.when(F.col("status_code") == 200, 0).otherwise(1)).alias("status_code"))
    named = assemble(responses).join(codes, "ident")
    return named.select(F.substring_index("ident", ":", 1).alias("kind"), F.expr("substring(ident, instr(ident, ':') + 1)").alias("ident"), "status_code", "title", "authors")


def write_token_bags(sources: DataFrame, path: str) -> None:
    """What a fixture keeps of each source, as gzipped JSON: token counts of body and bibliography, figures and halves of split words, never the text."""
    token_bags(sources).write.option("compression", "gzip").json(path)
