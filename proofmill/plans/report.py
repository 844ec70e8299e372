"""Reports of a findings table: text, JSON and exit codes. Only bounded lists come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..operators import findings
from ..operators.tables import written

LIMITS = "This is a first pass, not an audit: it matches patterns and compares numbers. VERIFIED means 'matched something in your files or a public record', not 'correct'; FLAGGED means 'look at this', not 'wrong'."
SCHEMA_VERSION = 1


def text_report(found: DataFrame, ran: list[str], show: tuple[str, ...] = (findings.FLAGGED,), limit: int = 200) -> str:
    """Sections in fixed order, at most `limit` rows each, and what was left out."""
    counts = {r.check: r for r in findings.summary(found, ran).collect()}
    rows: dict[str, list] = {}
    for r in findings.listed(found.where(F.col("status").isin(*show) | (F.col("check") == "scan")), limit).orderBy("check", "place").collect():
        rows.setdefault(r.check, []).append(r)
    out = ["document audit", "=" * 60, LIMITS, ""]
    for check in findings.CHECKS:
        if check not in counts:
            continue
        c = counts[check]
        out.append(f"[{check}] flagged {c.flagged}, unverifiable {c.unverifiable}, verified {c.verified}")
        for r in rows.get(check, []):
            out.append(f"  {r.status:<12} {r.file}:{r.line}  {r.message}" + (f"\n               {r.evidence}" if r.evidence else ""))
        if rows.get(check) and rows[check][0].trimmed:
            out.append(f"  ... and {rows[check][0].trimmed} more, not listed")
        out.append("")
    return "\n".join(out)


def top_report(found: DataFrame, n: int) -> str:
    rows = findings.top(found, n).collect()
    return "\n".join([LIMITS, "", *(f"{i}. [{r.check}] {r.file}:{r.line}  {r.message}" for i, r in enumerate(rows, 1))])


def json_report(found: DataFrame, ran: list[str]) -> str:
    """The whole report as one JSON document; for large audits see write_json_report."""
    counts = {r.check: {"VERIFIED": r.verified, "FLAGGED": r.flagged, "UNVERIFIABLE": r.unverifiable} for r in findings.summary(found, ran).collect()}
    total = findings.totals(found).first()
    rows = [r.asDict(recursive=True) for r in found.orderBy("check", findings.status_rank(), "file", "line").toLocalIterator()]
    return json.dumps({"schema_version": SCHEMA_VERSION, "tool_version": __version__, "limits": LIMITS, "counts": total.asDict(), "summary": counts, "skipped": [], "error": None, "findings": rows}, ensure_ascii=False, indent=1)


def write_json_report(found: DataFrame, ran: list[str], path: str) -> None:
    """The same document as part files in a folder: put together in the order of their names they are one JSON text. Every finding is written by the task that holds it; only counts
    come to the driver."""
    counts = {r.check: {"VERIFIED": r.verified, "FLAGGED": r.flagged, "UNVERIFIABLE": r.unverifiable} for r in findings.summary(found, ran).collect()}
    head = {"schema_version": SCHEMA_VERSION, "tool_version": __version__, "limits": LIMITS, "counts": findings.totals(found).first().asDict(), "summary": counts, "skipped": [], "error": None}
    keys = ["check", "rank", "file", "line", "message", "number"]
    # A number makes the order strict, so exactly one row is the first, the one without a comma before it.
    rows = found.select("*", findings.status_rank().alias("rank"), F.monotonically_increasing_id().alias("number"))
    rows = written(rows.select(*keys, F.to_json(F.struct(*findings.COLUMNS), {"ignoreNullFields": "false"}).alias("said")), "report")
    first = rows.agg(F.min(F.struct(*keys)).alias("first"))
    comma = F.when(F.struct(*keys) == F.col("first"), "").otherwise(",")
    body = rows.join(F.broadcast(first)).select(F.lit(1).alias("section"), *keys, F.concat(comma, "said").alias("said"))
    ends = found.sparkSession.createDataFrame([(0, json.dumps(head, ensure_ascii=False)[:-1] + ', "findings": ['), (2, "]}")], "section int, said string")
    whole = body.unionByName(ends, allowMissingColumns=True)
    whole.repartitionByRange("section", *keys).sortWithinPartitions("section", *keys).select("said").write.text(path)


def error_json(why: str) -> str:
    return json.dumps({"schema_version": SCHEMA_VERSION, "tool_version": __version__, "limits": LIMITS, "counts": {}, "summary": {}, "skipped": [], "error": why, "findings": []})


def exit_code(found: DataFrame, fail_on: str = "flagged") -> int:
    """1 if a file could not be read or a row has the status that fails, else 0."""
    unread = (F.col("extra")["unread"] == "true")
    bad = {"flagged": F.col("status") == findings.FLAGGED, "unverifiable": F.col("status") != findings.VERIFIED, "never": F.lit(False)}[fail_on]
    return int(len(found.where(F.coalesce(unread, F.lit(False)) | bad).limit(1).take(1)) > 0)
