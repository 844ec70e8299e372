"""Matches of a pattern with their places, in DataFrame functions alone.

Every array is bound once (`let`) before lambdas read it: what stands inside a lambda is evaluated again for each element.
Running values come from two levels of folds, so a text with many matches costs in proportion to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values folded one after the other; longer lists are cut into runs of so many.
RUN = 128
MATCHES = "array<struct<start:int,end:int,match:string>>"
MATCHES_IN_CONTEXT = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plus(a: Column, b: Column) -> Column:
    return a + b


def running(values: Column, op: Callable[[Column, Column], Column], first: int) -> Column:
    """For each of the integers, op over those before it; `first` is op's neutral value."""
    begin = F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def spread(runs: Column) -> Column:
        before = F.aggregate(F.transform(runs, lambda r: r["at"]), begin, step)["out"]
        return F.flatten(F.zip_with(runs, before, lambda r, b: F.transform(r["out"], lambda x: op(b, x))))

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda r: F.aggregate(F.slice(v, r * RUN + 1, F.lit(RUN)), begin, step))
        return F.when(F.size(v) > 0, let(runs, spread)).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def find_spans(text: Column, pattern: str, context: bool = False) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, match); places count code points, end exclusive.

    The pattern must match at least one character. The texts between matches give the places, so a text is scanned once,
    and once more if it has matches, whatever their number; if context, the structs hold the texts before and after too.
    """
    def placed(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda b: joined_up(found, b))).otherwise(F.array().cast(MATCHES_IN_CONTEXT if context else MATCHES))

    def joined_up(found: Column, between: Column) -> Column:
        gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), F.length)
        ends = running(F.zip_with(gaps, F.transform(found, F.length), plus), plus, 0)
        starts = F.zip_with(ends, gaps, plus)
        place = lambda s, m: (s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match"))
        out = F.zip_with(starts, found, lambda s, m: F.struct(*place(s, m)))
        if not context:
            return out
        sides = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.slice(between, F.lit(2), F.size(found)), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        return F.zip_with(out, sides, lambda m, s: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after")))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def touching(spans: Column, base: Column) -> Column:
    """For each of the spans (ascending, none twice) whether it overlaps one of base: running ends from the left, starts from the right."""
    tagged = lambda x, tag: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(tag).alias("tag"), s["end"].alias("end")))
    last = 2**31 - 1

    def flags(every: Column) -> Column:
        left = running(F.transform(every, lambda x: F.when(x["tag"] == 0, x["end"]).otherwise(0)), F.greatest, 0)
        right = F.reverse(running(F.transform(F.reverse(every), lambda x: F.when(x["tag"] == 0, x["start"]).otherwise(last)), F.least, last))
        sides = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        met = F.zip_with(every, sides, lambda x, s: F.struct(x["tag"].alias("tag"), ((s["a"] > x["start"]) | (s["b"] < x["end"])).alias("met")))
        return F.transform(F.filter(met, lambda m: m["tag"] == 1), lambda m: m["met"])

    def both(s: Column, b: Column) -> Column:
        none = F.transform(s, lambda _: F.lit(False))
        return F.when((F.size(s) > 0) & (F.size(b) > 0), let(F.array_sort(F.concat(tagged(b, 0), tagged(s, 1))), flags)).otherwise(none)

    return let(spans, lambda s: let(base, lambda b: both(s, b)))


def apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of base."""
    def kept(s: Column) -> Column:
        both = F.zip_with(s, touching(s, base), lambda x, met: F.struct(x.alias("span"), met.alias("met")))
        return F.transform(F.filter(both, lambda x: ~x["met"]), lambda x: x["span"])

    return let(spans, kept)


def labelled(spans: Column, kind: int) -> Column:
    """Spans as (start, kind, end), which sorts by place and then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, names: list[str]) -> Column:
    """The text with each span (start, kind, end) replaced by the name of its kind; overlapping spans give one name, the first one's.

    Pieces are cut from parts of the text that hold RUN spans each, so no piece is searched for from the text's beginning.
    """
    labels = F.array(*map(F.lit, names))

    def cut(parts: Column) -> Column:
        """parts: sorted (from, start, end, kind), `from` being the largest end before; a part that starts before it adds nothing."""
        n = F.size(parts)
        place = lambda i: F.get(parts, i)["from"]
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")),
            lambda r: F.struct(place(r * RUN).alias("at"), F.slice(parts, r * RUN + 1, F.lit(RUN)).alias("own"), F.when((r + 1) * RUN < n, place((r + 1) * RUN) - place(r * RUN)).otherwise(F.length(text)).alias("size")),
        )
        blocks = F.transform(runs, lambda r: F.struct(r["at"].alias("at"), r["own"].alias("own"), F.substring(text, r["at"] + 1, r["size"]).alias("block")))

        def pieces(b: Column) -> Column:
            own = F.transform(b["own"], lambda p: F.when(p["start"] >= p["from"], F.concat(F.substring(b["block"], p["from"] - b["at"] + 1, p["start"] - p["from"]), F.get(labels, p["kind"]))).otherwise(""))
            return F.array_join(own, "")

        def rest(p: Column) -> Column:
            return F.substring(text, F.greatest(p["from"], p["end"]) + 1, F.length(text))

        return F.concat(F.array_join(F.transform(blocks, pieces), ""), rest(F.element_at(parts, -1)))

    def prepared(s: Column) -> Column:
        before = running(F.transform(s, lambda x: x["end"]), F.greatest, 0)
        parts = F.zip_with(s, before, lambda x, f: F.struct(f.alias("from"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.when(F.size(s) > 0, let(parts, cut)).otherwise(text)

    return let(F.array_sort(spans), prepared)
