"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds (assign, access, hex) are found by pattern and always reported. Beyond them a text has weak parts:
identifiers (`weak_id`: a user, account, client or key id that is given a value), secrets (`weak_secret`: a short
key or password that is given a value, or a long token of mixed characters) and endpoints (`endpoint`: a URL, or a host
with a port). Each alone is noise. Parts are linked within their scope (text without a blank line), however far
apart: an interval join gives every part the nearest one of each other side, by the gap between the two intervals, the one before it where gaps are
equal. It looks once forth and once back through the scope's parts in order, so a scope of many parts makes no pairs. Weak parts are
reported only where they are linked with what complements them: an identifier with a secret, a secret with an identifier, an endpoint with both.
Base access keys count as identifiers, the other base kinds as secrets. `links` lists the credentials, for every identifier
its nearest secret and endpoint.

Defined results: a null text is an empty one. Rows that are repeated as a whole get the same result each; other columns are not
read, whatever their names. Parts that touch one another do not overlap; of overlapping ones the base part stays, then the identifier.
Texts of any length and with any number of parts are scanned whole. Places are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .spans import SPANS, apart, counted, find_spans, joined, labelled, let, plus, running

KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is long enough starts where the run starts, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_ID = r"""(?i:(?<![a-z0-9])(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
WEAK_SECRET = r"""(?i:(?<![a-z0-9])(?:pass|pwd|passphrase|key|auth|credential|private_?key|secret_?key|access_?token))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=@!#$%-]{6,}+|(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])(?=[a-z0-9+/=_-]*+[A-Z])(?=[A-Z0-9+/=_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}"""
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z0-9]+|postgres|mysql|mongodb|redis)://[^\s"'<>]++|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}(?![0-9])"""
#: Kind of a blank line among the spans of a text, and the sides that kinds belong to.
BREAK = 9
SIDES = {"id": [1, 3], "secret": [0, 2, 4], "place": [5]}


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds."""
    long_enough = F.filter(find_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 12)
    return {"assign": long_enough, "access": find_spans(text, ACCESS), "hex": find_spans(text, HEX)}


def _scoped(spans: Column) -> Column:
    """Spans with the number of their scope, that is, of the breaks before them."""
    def numbered(every: Column) -> Column:
        scopes = running(F.transform(every, lambda x: F.when(x["kind"] == BREAK, 1).otherwise(0)), plus, 0)
        return F.filter(F.zip_with(every, scopes, lambda x, n: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), n.alias("scope"))), lambda x: x["kind"] != BREAK)

    return let(F.array_sort(spans), numbered)


def link_parts(parts: DataFrame) -> DataFrame:
    """parts (key, scope, kind, start, end), distinct, with id, secret and place: the nearest part (start, end) of each side in the scope, the part itself for its own side."""
    # Both ways as a running value: a frame up to the last row would be gone through again for every row.
    scope = Window.partitionBy("key", "scope").rowsBetween(Window.unboundedPreceding, -1)
    back, forth = scope.orderBy("start", "kind", "end"), scope.orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    span = F.struct("start", "end")
    out = parts.select("*", *(F.last(F.when(F.col("kind").isin(kinds), span), True).over(w).alias(f"{side}_{at}") for w, at in ((back, "before"), (forth, "after")) for side, kinds in SIDES.items()))
    gap = lambda a, b: F.greatest(b - a, F.lit(0))

    def nearest(side: str) -> Column:
        before, after = F.col(f"{side}_before"), F.col(f"{side}_after")
        near = F.when(before.isNull(), after).when(after.isNull() | (gap(before["end"], F.col("start")) <= gap(F.col("end"), after["start"])), before).otherwise(after)
        return F.when(F.col("kind").isin(SIDES[side]), span).otherwise(near)

    return out.select(*parts.columns, *(nearest(side).alias(side) for side in SIDES))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_assign, n_access, n_hex, base_sha256, spans, n_weak_id, n_weak_secret, n_endpoint, links: one row per input row."""
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    found = rows.select("*", *(c.alias(k) for k, c in base_spans(text).items()))
    found = found.withColumn("base", F.concat(*(labelled(F.col(k), i) for i, k in enumerate(KINDS[:3]))))
    nothing = F.array().cast(SPANS)
    found = found.withColumn("ids", labelled(apart(find_spans(text, WEAK_ID), F.col("base")), 3))
    some_id = (F.size("ids") > 0) | (F.size("access") > 0)
    found = found.withColumn("secrets", F.when(some_id, labelled(apart(find_spans(text, WEAK_SECRET), F.concat("base", "ids")), 4)).otherwise(nothing))
    some_both = some_id & ((F.size("secrets") > 0) | (F.size("assign") > 0) | (F.size("hex") > 0))
    found = found.withColumn("places", F.when(some_both, labelled(apart(find_spans(text, ENDPOINT), F.col("base")), 5)).otherwise(nothing))
    breaks = labelled(find_spans(text, r"\n[\t\r\x20]*+(?=\n)"), BREAK)
    kept = found.select(
        "id", "base", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.when(some_both, _scoped(F.concat("base", "ids", "secrets", "places", breaks))).alias("parts"), F.when(some_both, F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit("|"), "text"))).alias("key"),
    )
    kept = scratch.write(kept, "found")

    part = kept.where("key is not null").select("key", F.explode("parts").alias("p")).select("key", "p.*").distinct()
    near = link_parts(part)
    linked = near.where(F.col("id").isNotNull() & F.col("secret").isNotNull())
    place = lambda c: F.concat_ws(":", F.col(c)["start"], F.col(c)["end"])
    link = F.when(F.col("kind").isin(SIDES["id"]), F.struct("start", F.concat_ws(">", place("id"), place("secret"), F.when(F.col("place").isNotNull(), place("place"))).alias("said")))
    linked = linked.groupBy("key").agg(F.collect_list(F.when(F.col("kind") >= 3, F.struct("start", "kind", "end"))).alias("weak"), F.array_sort(F.collect_list(link)).alias("link"))
    # Rows without linkable parts, most of them, have no key and go past the join.
    none = kept.where("key is null").select("*", nothing.alias("weak"), F.lit("").alias("links"))
    some = kept.where("key is not null").join(linked.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").select(*kept.columns, F.coalesce("weak", nothing).alias("weak"), F.coalesce(F.array_join(F.col("link.said"), ","), F.lit("")).alias("links"))
    out = some.unionByName(none)
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "weak"), KINDS).alias("spans"),
        *(counted("weak", i).alias(f"n_{KINDS[i]}") for i in (3, 4, 5)), "links",
    )
