"""A whole audit: read a folder, run the checks that are asked for, return one lazy table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_tex
from ..operators import arithmetic, citation, collected, consistency, findings, json_index, overclaim, registry, source_check, support, values
from ..operators.mentions import surnames
from ..operators.sentences import LONG, extract_claims, split_documents
from ..sources import files as sources

ALL = ["overclaim", "source", "consistency", "citation", "benchmark", "seeds", "registry"]
#: Checks that run only where they are named.
NAMED = ["support"]
# Names under which a registry is found, the first wins; the first two are this engine's own.
REGISTRY_NAMES = ["proofmill-claims.json", "proofmill-claims.csv", "claims.json", "claims.csv"]
# How TeX includes a PDF.
PDF = r"(?i)\\(?:(includepdf)\*?(?:\[[^\]]*\])?\{([^{}]*)\}|(includegraphics)\*?(?:\[[^\]]*\])?\{([^{}]*\.pdf)\})"


def silence(rel: Column, text: Column, known: Column) -> Column:
    """Why a container holds no prose (null if it does): known reasons of readers, and TeX without sentences or around a PDF alone."""
    bare = F.regexp_replace(text, r"(?<!\\)%.*", "")
    body = F.nullif(F.regexp_extract(bare, r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)", 1), F.lit(""))
    spoken = lambda t: strip_tex(t).rlike(r"\S")
    where = F.coalesce(body, bare)
    part = lambda *groups: F.concat(*(F.regexp_extract(where, PDF, g) for g in groups))
    wraps = F.concat(F.lit("it wraps a PDF ("), F.trim(part(2, 4)), F.lit(") with \\"), part(1, 3), F.lit(", and PDFs are not read, so the paper's text was never seen"))
    why = F.when(where.rlike(PDF), wraps).otherwise("stripping the LaTeX produced no readable sentences")
    silent = ~spoken(text) | (body.rlike(PDF) & ~spoken(body))
    return F.when(F.lower(rel).endswith(".tex"), F.when(F.coalesce(silent, F.lit(False)), why)).otherwise(known)


def scan_findings(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """What was not read: too large, undecodable, empty, or parts of a document besides its body."""
    unread = F.create_map(F.lit("unread"), F.lit("true"))
    large = findings.findings(listed.where(F.col("length") > sources.MOST_BYTES), "scan", findings.UNVERIFIABLE, "rel", 0, F.concat(F.lit("is "), F.col("length").cast("string"), F.lit(f" bytes, over the limit of {sources.MOST_BYTES}, so this file was not audited")), None, unread)
    failed = findings.findings(texts.where("error is not null"), "scan", findings.UNVERIFIABLE, "rel", 0, F.concat(F.lit("could not be read, so it was not checked: "), "error"), None, unread)
    why = silence(F.col("rel"), F.col("text"), F.col("silence"))
    empty = findings.findings(texts.where("kind = 'text' and error is null").withColumn("why", why).where("why is not null"), "scan", findings.UNVERIFIABLE, "rel", 0, F.lit("no prose could be read from this file, so none of it was checked"), F.col("why"), unread)
    nothing = findings.findings(texts.where("error is null").agg(F.count("*").alias("n")).where("n = 0"), "scan", findings.FLAGGED, F.lit(""), 0, F.lit("no readable documents were found here, so nothing was checked"), F.lit(f"read are {', '.join(sources.TEXT + sources.BIB)}"))
    parts = findings.findings(texts.where(F.size("unread") > 0), "scan", findings.UNVERIFIABLE, "rel", 0, F.concat(F.lit("this document also has "), F.array_join("unread", ", "), F.lit(", which were not read, so nothing in them was checked")))
    return large.unionByName(failed).unionByName(empty).unionByName(parts).unionByName(nothing)


def collected_note(found: DataFrame, docs: DataFrame) -> DataFrame:
    """One row if directories look collected: how many documents they hold, and their share of the findings."""
    folder = lambda path: F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    groups = collected.collected_directories(docs.select(folder(F.col("rel")).alias("dir"), "text"))
    of = groups.agg(F.sum("files").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("dir")), 1, 3), ", ").alias("dirs")).where("n > 0")
    own = found.where("check <> 'scan'").select(folder(F.col("file")).alias("dir")).join(groups.select("dir", F.lit(1).alias("inside")), "dir", "left").agg(F.count("*").alias("total"), F.count("inside").alias("inside"))
    # Two frames of one row each meet on a constant.
    rows = of.withColumn("one", F.lit(1)).join(own.withColumn("one", F.lit(1)), "one").join(docs.agg(F.count("*").alias("documents")).withColumn("one", F.lit(1)), "one")
    share = F.when(F.col("total") > 0, F.format_string(", and account for %d%% of the findings", F.round(100 * F.col("inside") / F.col("total")).cast("int"))).otherwise("")
    message = F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("documents").cast("string"), F.lit(" documents look collected rather than written by you"), share, F.lit(": a guess from the shape of the files"))
    return findings.findings(rows, "scan", findings.UNVERIFIABLE, F.lit(""), 0, message, F.col("dirs"))


def audit(spark: SparkSession, root: str, only: list[str] | None = None, records: DataFrame | None = None, strict: bool = False, exclude: list[str] | None = None, registry_path: str | None = None, most_urls: int = 60, cited: DataFrame | None = None, replies: DataFrame | None = None) -> DataFrame:
    """Findings of all checks (or those in `only`, which may name support) over a folder.

    records is what citation.check_citations takes, cited what support.check_support takes as sources (sources.records.assemble makes both from recorded
    answers), replies what judge.judge_claims takes.
    """
    wanted = only or ALL
    if unknown := set(wanted) - {*ALL, *NAMED}:
        raise ValueError(f"unknown check: {', '.join(sorted(unknown))}")
    listed = sources.list_files(spark, root, exclude)
    texts = sources.read_texts(listed).cache()  # read once, used by every check
    docs = texts.where("kind = 'text' and text is not null").select("rel", "ord", "text")
    long = listed.where((F.col("kind") == "text") & F.col("length").between(LONG + 1, sources.MOST_BYTES)).select("rel").limit(1).take(1)
    lines = split_documents(docs, long=LONG if long else None).cache()
    parts = [scan_findings(listed, texts)]
    if "overclaim" in wanted:
        parts.append(overclaim.check_overclaims(lines, strict))
    if "source" in wanted or "consistency" in wanted:
        claims = extract_claims(lines).cache()
        if "source" in wanted:
            names = [r.rel for r in listed.where("kind = 'data'").select("rel").orderBy("ord").collect() if r.rel.lower().endswith(".csv")]
            tables = {n: sources.read_csv(spark, f"{root.rstrip('/')}/{n}") for n in names}
            indexed = [values.index_table(t, n, next((c for c, _ in t.dtypes), None)) for n, t in tables.items() if t.columns]
            known = [values.file_info(t, n) for n, t in tables.items() if t.columns]
            walked = json_index.walk_json(listed.where("kind = 'data' and lower(rel) like '%.json'").where(~F.col("rel").isin(REGISTRY_NAMES) & (F.col("length") <= sources.MOST_BYTES)).select(F.col("rel").alias("file"), F.decode("content", "UTF-8").alias("text"))).cache()
            index, info = reduce(DataFrame.unionByName, [*indexed, json_index.index_json(walked)]), reduce(DataFrame.unionByName, [*known, json_index.json_info(walked)])
            parts.append(source_check.check_sources(claims, index, info))
            parts.append(findings.findings(walked.where("cut"), "scan", findings.UNVERIFIABLE, "file", 0, F.lit("is deeper or wider than the walk's budget, so some values in it were not indexed")))
        if "consistency" in wanted:
            parts.append(consistency.check_consistency(claims))
    if "citation" in wanted:
        parts.append(citation.check_citations(docs, sources.read_bibliography(texts), records, most_urls))
    if "support" in wanted:
        entries = citation.bib_identifiers(sources.read_bibliography(texts).where("lower(rel) like '%.bib'")).select("key", F.concat("kind", F.lit(":"), "ident").alias("ident"), F.struct("ord", "line").alias("ord"), surnames(F.coalesce(F.col("fields")["author"], F.lit(""))).alias("authors"))
        parts.append(support.check_support(docs, entries, cited, replies, most_urls))
    if "benchmark" in wanted:
        parts.append(arithmetic.check_benchmarks(lines))
    if "seeds" in wanted:
        parts.append(arithmetic.check_seeds(lines))
    if "registry" in wanted:
        have = {r.rel for r in listed.where(F.col("rel").isin(REGISTRY_NAMES)).select("rel").collect()}
        path = registry_path or next((f"{root.rstrip('/')}/{n}" for n in REGISTRY_NAMES if n in have), None)
        parts.append(registry.check_registry(docs, sources.read_registry(spark, path), path.rsplit("/", 1)[-1]) if path else registry.no_registry(docs, REGISTRY_NAMES))
    found = findings.union(spark, parts).cache()  # read twice: as it is, and for the note's share
    return found.unionByName(collected_note(found, docs))
