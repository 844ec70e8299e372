"""Citations against recorded metadata: what is cited, where it was first seen, and whether the record agrees.

Records are a table (kind, ident, status_code, title, authors), collected outside of the engine; nothing here opens a
connection. Without records every identifier is reported as not checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import FLAGGED, UNVERIFIABLE, VERIFIED, findings
from .mentions import ARXIV, URL, find_mentions, first_seen, normal_name, surnames, title_similarity

RECORDS = "kind string, ident string, status_code int, title string, authors array<string>"
# Answers that say nothing about whether the thing exists.
BLOCKED = [0, 401, 403, 405, 406, 408, 425, 429, 451]


def bib_identifiers(bib: DataFrame) -> DataFrame:
    """Entries with (kind, ident): arXiv before DOI before URL."""
    field = lambda k: F.coalesce(F.col("fields")[k], F.lit(""))
    eprint = F.when(field("eprint").rlike(r"^\d{4}\.\d{4,5}$"), field("eprint"))
    linked = F.nullif(F.regexp_extract(F.concat_ws(" ", field("journal"), field("url"), field("note")), ARXIV, 1), F.lit(""))
    arxiv, doi = F.coalesce(eprint, linked), F.nullif(F.trim(field("doi")), F.lit(""))
    url = F.nullif(F.coalesce(F.nullif(field("url"), F.lit("")), F.regexp_extract(field("note"), URL, 0)), F.lit(""))
    out = bib.where("unread is null").withColumn("kind", F.when(arxiv.isNotNull(), "arxiv").when(doi.isNotNull(), "doi").when(url.isNotNull(), "url"))
    return out.withColumn("ident", F.coalesce(arxiv, doi, url)).where("kind is not null")


def all_mentions(docs: DataFrame, bib: DataFrame) -> DataFrame:
    """First-seen place of every identifier: bibliography URLs, then text, then the bibliography's own."""
    inline = find_mentions(docs.withColumnRenamed("ord", "file_ord")).select("kind", "ident", "rel", "line", F.lit(1).alias("phase"), "file_ord", "kind_ord", "pos")
    entries = bib_identifiers(bib).select("kind", "ident", "rel", "line", F.when(F.col("kind") == "url", 0).otherwise(2).alias("phase"), F.col("ord").alias("file_ord"), F.lit(0).alias("kind_ord"), F.lit(0).alias("pos"))
    return first_seen(inline.unionByName(entries), ["phase", "file_ord", "line", "kind_ord", "pos"])


def _authors_differ(entry: Column, record: Column) -> Column:
    want = surnames(entry)
    have = F.transform(record, lambda a: F.element_at(F.split(normal_name(a), " "), -1))
    cut = F.lower(entry).rlike(r"\bothers\b|et al")
    return F.coalesce((entry != "") & (F.size(record) > 0) & (F.when(cut, F.slice(have, F.lit(1), F.greatest(F.size(want), F.lit(1)))).otherwise(have) != want), F.lit(False))


def check_citations(docs: DataFrame, bib: DataFrame, records: DataFrame | None, most_urls: int = 60) -> DataFrame:
    seen = all_mentions(docs, bib)
    unread = bib.where("unread is not null").groupBy("rel").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.array_join(F.slice(F.array_sort(F.collect_list(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" "), "key", F.lit(": "), "unread"))), 1, 5), "; ").alias("which"))
    out = findings(unread, "citation", UNVERIFIABLE, "rel", "line", F.concat(F.col("n").cast("string"), F.lit(" bibliography identifier(s) were present but not parsed, so not checked")), F.col("which"))
    if records is None:
        return out.unionByName(findings(seen, "citation", UNVERIFIABLE, "rel", "line", F.concat("kind", F.lit(" "), "ident", F.lit(": not checked (offline)"))))
    # The last entry of an identifier stands for it.
    entry = bib_identifiers(bib).where("kind <> 'url'").groupBy("kind", "ident").agg(F.max_by(F.struct("rel", "line", "fields"), F.struct("ord", "line")).alias("e"))
    urls = seen.where("kind = 'url'").orderBy("phase", "file_ord", "line", "pos").limit(most_urls)
    rows = seen.where("kind <> 'url'").unionByName(urls).join(records, ["kind", "ident"], "left").join(entry, ["kind", "ident"], "left")
    field = lambda k: F.coalesce(F.col("e.fields")[k], F.lit(""))
    comparable = F.col("e").isNotNull() & ((field("author") != "") | (field("title") != "")) & F.col("kind").isin("arxiv", "doi")
    wrong_names = comparable & _authors_differ(field("author"), F.coalesce("authors", F.array().cast("array<string>")))
    wrong_title = comparable & (field("title") != "") & (F.coalesce("title", F.lit("")) != "") & (title_similarity(field("title"), F.col("title")) < 0.5)
    code = F.col("status_code")
    found, dead = code.between(200, 399), code.isin(404, 410)
    rule = F.when(code.isNull() | code.isin(BLOCKED) | (code >= 500), "unreached").when(found & (wrong_names | wrong_title), "differs").when(found, "resolves").when(dead, "absent").otherwise("unreached")
    rows = rows.withColumn("rule", rule).withColumn("status", F.when(F.col("rule") == "resolves", VERIFIED).when(F.col("rule").isin("differs", "absent"), FLAGGED).otherwise(UNVERIFIABLE))
    name = F.when(F.col("kind") == "arxiv", F.concat(F.lit("arXiv:"), "ident")).when(F.col("kind") == "doi", F.concat(F.lit("DOI "), "ident")).otherwise(F.concat(F.lit("URL "), F.substring("ident", 1, 90)))
    said = F.when(F.col("rule") == "differs", ": bib entry does not match the record").when((F.col("rule") == "resolves") & comparable, ": matches bib authors/title").when(F.col("rule") == "resolves", ": resolves").when((F.col("rule") == "absent") & (F.col("kind") == "url"), ": URL is dead").when(F.col("rule") == "absent", ": not found").otherwise(": could not be checked")
    why = F.concat_ws("; ", F.when(wrong_names, F.concat(F.lit("authors differ: record "), F.array_join("authors", ", "))), F.when(wrong_title, F.concat(F.lit("title differs: record "), F.substring("title", 1, 60))))
    at_entry = (F.col("kind") == "arxiv") & F.col("e").isNotNull()
    return out.unionByName(findings(rows, "citation", "status", F.when(at_entry, F.col("e.rel")).otherwise(F.col("rel")), F.when(at_entry, F.col("e.line")).otherwise(F.col("line")), F.concat(name, said), F.when(F.col("rule") == "differs", why)))
