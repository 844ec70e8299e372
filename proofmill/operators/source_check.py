"""Numeric claims against the value index: a band join on buckets, word scores, and the verdict of each claim.

A claimed number meets the values within half a unit of its last printed place. Values and targets share a bucket of
that width (or a wider one where the relative slack of large numbers needs it), targets also visit the
neighbouring buckets, so the band join is an equi-join whose matches are re-checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.precision import evidence_needed, shown as printed
from .findings import FLAGGED, UNVERIFIABLE, VERIFIED, findings


def band(decimals: Column, value: Column) -> Column:
    """Half a unit of the last place, with relative slack for rounding."""
    return 0.5 * F.pow(F.lit(10.0), -decimals.cast("double")) * 1.0001 + 1e-9 * F.greatest(F.lit(1.0), F.abs(value))


def targets(claims: DataFrame) -> DataFrame:
    """Each number of each claim as what to look up: (claim_id, num, target, tol, part, ...)."""
    n = claims.select("claim_id", "tokens", F.posexplode("nums").alias("num", "n")).select("claim_id", "tokens", "num", "n.*")
    look = lambda target, tol, part: F.struct(target.alias("target"), tol.alias("tol"), F.lit(part).alias("part"))
    v, d = F.col("value"), F.col("decimals")
    plain = F.array(look(v, band(d, v), "v"))
    negated = F.array(look(-v, band(d, v), "v"))
    share = F.array(look(v / 100, band(d + 2, v / 100), "v"))
    ratio = F.array(look(v, F.lit(0.5), "a"), look(F.col("den"), F.lit(0.5), "b"))
    nothing = F.slice(plain, F.lit(1), F.lit(0))
    every = F.when(F.col("kind") == "ratio", ratio).otherwise(F.concat(plain, F.when((F.col("kind") == "pp") | (v < 0), negated).otherwise(nothing), F.when(F.col("kind") == "pct", share).otherwise(nothing)))
    return n.select("claim_id", "tokens", "num", "value", "raw", "kind", "den", F.explode(every).alias("look")).select("claim_id", "tokens", "num", "value", "raw", "kind", "den", "look.*")


def band_join(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """wanted (target, tol, ...) with values (value as v, ...) where |v - target| <= tol."""
    # The bucket's width is the least power of ten of at least twice the tolerance.
    wanted = wanted.withColumn("width", F.ceil(F.log10(2 * F.col("tol")) - 1e-9).cast("int"))
    scale = F.pow(F.lit(10.0), F.col("width").cast("double"))
    wanted = wanted.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("target") - F.col("tol")) / scale) - 0, F.floor((F.col("target") + F.col("tol")) / scale))))
    widths = sorted(r.width for r in wanted.select("width").distinct().collect() if r.width is not None)  # a handful: printed precisions
    held = values.withColumnRenamed("value", "v").withColumn("width", F.explode(F.array(*map(F.lit, widths)).cast("array<int>"))).withColumn("bucket", F.floor(F.col("v") / scale))
    return wanted.join(held, ["width", "bucket"]).where(F.abs(F.col("v") - F.col("target")) <= F.col("tol")).drop("width", "bucket")


def score(claim_tokens: str = "tokens") -> Column:
    """Two for each column word, one for each word of the file name, one for any word of the row's label, two for rows counted."""
    shared = lambda c: F.size(F.array_intersect(claim_tokens, c))
    rows = F.when((F.col("where") == "row count") & F.arrays_overlap(claim_tokens, F.array(F.lit("row"), F.lit("rows"))), 2).otherwise(0)
    return 2 * shared("col") + shared("stem") + F.least(shared("label"), F.lit(1)) + rows


def referenced_files(claims: DataFrame, files: DataFrame, most: int = 100_000) -> DataFrame:
    """(claim_id, file): tables that a sentence points at by name, by all of three or more words of it, or by a header.

    Names and headers are found by one automaton for all of them, so claims meet files without a cross join. The list of
    files is metadata; more than `most` of them are an error rather than a broadcast.
    """
    known = files.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} data files")
    literals: dict[str, list[tuple[str, bool]]] = {}
    for r in known:
        stem = r.name.rsplit(".", 1)[0]
        plain = {r.name, r.file.lower(), *(h.lower() for h in r.headers if len(h) >= 4 and ("_" in h or " " in h))}
        for x in plain:
            literals.setdefault(x, []).append((r.file, False))
        if len(stem) >= 5 and ("_" in stem or "-" in stem):
            literals.setdefault(stem, []).append((r.file, True))
    by_words: dict[str, list[tuple[str, frozenset]]] = {}
    for r in known:
        if len(r.stem) >= 3:
            by_words.setdefault(min(r.stem), []).append((r.file, frozenset(r.stem)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for x, owners in literals.items():
            machine.add_word(x, (x, owners))
        if literals:
            machine.make_automaton()
        word = lambda c: c.isalnum() or c == "_"
        for b in batches:
            ids, files = [], []
            for i, sentence, toks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                low, found = sentence.lower(), set()
                for end, (x, owners) in machine.iter(low) if literals else ():
                    start, after = end - len(x), low[end + 1 : end + 2]
                    alone = not (start >= 0 and word(low[start])) and not (after and word(after))
                    found |= {f for f, whole in owners if alone or not whole}
                have = set(toks)
                found |= {f for t in toks for f, stem in by_words.get(t, ()) if stem <= have}
                ids += [i] * len(found)
                files += sorted(found)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(files, pa.string())], ["claim_id", "file"])

    return claims.select("claim_id", "sentence", "tokens").mapInArrow(run, "claim_id long, file string")


def number_verdicts(claims: DataFrame, values: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(claim_id, num, raw, status, file, where, found): the verdict of each number, and the best value for it."""
    wanted = targets(claims)
    own = wanted.select("claim_id", "num", "raw", "kind", F.col("value").alias("stated"), "den").distinct()
    met = band_join(wanted, values).withColumn("score", score())
    # A ratio's parts need evidence by their own digits as whole numbers; other numbers by the printed ones.
    raw = F.when(F.col("part") == "v", F.col("raw")).when(F.col("part") == "a", F.col("value").cast("long").cast("string")).otherwise(F.col("den").cast("long").cast("string"))
    met = met.withColumn("good", F.col("score") >= evidence_needed(F.col("raw"))).withColumn("part_good", F.col("score") >= evidence_needed(raw))
    if refs is not None:
        met = met.join(refs.withColumn("named", F.lit(True)), ["claim_id", "file"], "left")
    else:
        met = met.withColumn("named", F.lit(None).cast("boolean"))
    # First in value order among equals, as in a sorted index.
    order = F.struct(F.col("v"), "file", "where")
    pick = lambda cond, key: F.min(F.when(cond, F.struct(*key, order.alias("o"))))["o"]
    per = met.groupBy("claim_id", "num").agg(
        pick(F.col("good"), [-F.col("score")]).alias("best"), pick(F.col("named"), []).alias("in_named"), pick(F.lit(True), []).alias("any"),
        pick((F.col("part") == "a") & F.col("part_good"), []).alias("num_hit"), pick((F.col("part") == "b") & F.col("part_good"), []).alias("den_hit"),
    )
    pointed = refs.select("claim_id").distinct().withColumn("points", F.lit(True)) if refs is not None else claims.select("claim_id").where("false").withColumn("points", F.lit(True))
    out = own.join(per, ["claim_id", "num"], "left").join(pointed, "claim_id", "left")
    both = (F.col("kind") == "ratio") & F.col("num_hit").isNotNull() & F.col("den_hit").isNotNull()
    status = F.when(both | F.col("best").isNotNull() | F.col("in_named").isNotNull(), VERIFIED).when(F.col("points"), FLAGGED).otherwise(UNVERIFIABLE)
    hit = F.when(both, F.col("num_hit")).otherwise(F.coalesce("best", "in_named", F.when(F.col("points").isNull(), F.col("any"))))
    return out.select("claim_id", "num", "raw", "stated", status.alias("status"), hit["file"].alias("file"), hit["where"].alias("where"), hit["v"].alias("found"), F.col("best").isNull().alias("no_words"))


def nearest_two(flagged: DataFrame, refs: DataFrame, values: DataFrame) -> DataFrame:
    """For each flagged number the two closest values of the tables that its sentence names."""
    near = flagged.select("claim_id", "num", "stated").join(refs, "claim_id").join(values.select(F.col("file"), F.col("where").alias("near_where"), F.col("value").alias("near")), "file")
    order = Window.partitionBy("claim_id", "num").orderBy(F.abs(F.col("near") - F.col("stated")), "near", "file", "near_where")
    return near.withColumn("place", F.row_number().over(order)).where("place <= 2").select("claim_id", "num", "place", "file", "near_where", "near")


def check_sources(claims: DataFrame, values: DataFrame, files: DataFrame) -> DataFrame:
    """Findings: one row for each claim; flagged if a number is, verified if all are."""
    refs = referenced_files(claims, files)
    each = number_verdicts(claims, values, refs)
    near = nearest_two(each.where(F.col("status") == FLAGGED), refs, values).groupBy("claim_id", "num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "near_where", "near"))), lambda x: F.concat(x["near_where"], F.lit("="), printed(x["near"]))), "; ").alias("near"))
    each = each.join(near, ["claim_id", "num"], "left")
    value = F.concat("file", F.lit(": "), "where", F.lit(" = "), printed(F.col("found")))
    text = F.when(F.col("status") == VERIFIED, value).when(F.col("status") == FLAGGED, F.concat(F.lit("the sentence points at data without this value; nearest: "), F.coalesce("near", F.lit("none")))).when(F.col("found").isNotNull(), F.concat(F.lit("equals "), "file", F.lit(": "), "where", F.lit(" but the sentence shares no words with it"))).otherwise("no matching value")
    part = F.struct("num", "status", F.concat(F.substring("status", 1, 1), F.lit(":"), "raw", F.lit(" "), text).alias("text"))
    folded = each.groupBy("claim_id").agg(F.bool_or(F.col("status") == FLAGGED).alias("flag"), F.bool_and(F.col("status") == VERIFIED).alias("ok"), F.array_sort(F.collect_list(part)).alias("parts"))
    status = F.when(F.col("flag"), FLAGGED).when(F.col("ok"), VERIFIED).otherwise(UNVERIFIABLE)
    shown = F.filter("parts", lambda p: (p["status"] != UNVERIFIABLE) | (F.col("status") == UNVERIFIABLE))
    rows = claims.select("claim_id", "rel", "line", "sentence").join(folded.withColumn("status", status), "claim_id")
    message = F.when(F.length("sentence") <= 150, F.col("sentence")).otherwise(F.concat(F.substring("sentence", 1, 147), F.lit("...")))
    return findings(rows, "source", "status", "rel", "line", message, F.substring(F.array_join(F.transform(shown, lambda p: p["text"]), " | "), 1, 400))
