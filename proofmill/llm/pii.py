"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions alone.

Base kinds (email, ip, card, phone) are found by pattern and always reported. They seed a bootstrap over the
whole corpus: each identifier-like token (one with a digit, @ or +, with the number groups that follow it) is an instance, the
words before it and around it are lexical patterns. In each round a pattern's confidence is the mean score of its
distinct instances, damped by their number, and an instance's score is the noisy-or of its patterns;
seeds score one. Rounds go on until none accepts a new instance, that is, lifts its score to `accept`.
Long numbers (`digits` digits or more, no fewer than their letters) take the noisy-or of all their patterns. Other
instances may be everyday tokens (12, 1st), for which many weak patterns would add up: they take that of the patterns with
a confidence of SURE or more, and nothing where more of their patterns are below it. Accepted instances are new
identifiers (kind `context`) wherever they occur, but short bare numbers only where their context says so: any
place whose own patterns, each SURE at least, have a noisy-or of `accept` is reported, whatever stands there.

The pattern-instance graph is a table; scoring is sums per pattern and per instance (combined map-side, so a
frequent pattern is no hot task) and equi-joins of the graph with those sums. Patterns and instances that hold more than
1/HOT of the rows (at most HOT of each) are joined by broadcast, so that none is a hot task. No group is gathered in one place.

Defined results: a null text is an empty one. Rows that are repeated as a whole get the same result each; other columns are not
read, whatever their names, and come back unchanged where texts are masked. Equal scores need no order: every instance at or above `accept`
is taken. Texts of any length and with any number of identifiers are scanned whole. Places are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, HOT_ROWS, Scratch, is_empty, join_unique, with_hot
from .spans import MATCHES, SPANS, counted, find_spans, joined, labelled, replaced, touching

KINDS = ["email", "ip", "card", "phone", "context"]
#: From this confidence on a pattern is more often personal than not.
SURE = 0.5
# Possessive, since what follows a run cannot begin inside it; a run is entered only at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Shorter chains of digits cannot hold a card.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TOKEN = r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+(?:\x20[(]?[0-9][0-9().-]*+(?!\S))*+"
#: Rows of a hot text are dealt to so many tasks.
SALTS = 64
#: Longer words stand in a pattern as their hash.
WORD = 80


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the checksum."""
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds; texts without the marks of a kind are not scanned for it."""
    nothing = F.array().cast(MATCHES)
    some = lambda mark, found: F.when(mark, found).otherwise(nothing)
    number = text.rlike("[0-9]")
    count = lambda s: F.length(_digits(s["match"]))
    return {
        "email": some(F.contains(text, F.lit("@")), find_spans(text, EMAIL)),
        "ip": some(number, F.filter(find_spans(text, IP), lambda s: s["match"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        "card": some(number, F.filter(find_spans(text, CARD), lambda s: F.when(count(s).between(14, 19), _luhn(_digits(s["match"]))).otherwise(False))),
        "phone": some(F.contains(text, F.lit("+")), F.filter(find_spans(text, PHONE), lambda s: count(s).between(10, 15))),
    }


def _word(x: Column) -> Column:
    return F.when(F.length(x) > WORD, F.md5(x)).otherwise(x)


def _last(x: Column, n: int) -> Column:
    """The last n words of x (fewer where it has fewer), found from its end."""
    words = F.filter(F.split(F.trim(F.reverse(F.regexp_extract(F.reverse(x), rf"^\s*+(\S++(?:\s++\S++){{0,{n - 1}}})", 1))), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: _word(F.lower(w))), " ")


def _first(x: Column) -> Column:
    return _word(F.lower(F.regexp_extract(x, r"^\s*+(\S++)", 1)))


def _found(docs: DataFrame, text_col: str, others: list[Column], tokens: bool = True) -> DataFrame:
    """Columns others, __key, __base and, if tokens, __tokens: map-only. __key is null where there is no token."""
    rows = docs.select(*others, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    names = [c for c in rows.columns if c != "__text"]
    text = F.col("__text")
    rows = rows.select("*", *(c.alias(f"__{k}") for k, c in base_spans(text).items()))
    rows = rows.withColumn("__base", F.concat(*(labelled(F.col(f"__{k}"), i) for i, k in enumerate(KINDS[:4]))))
    if not tokens:
        return rows.select(*names, "__base", F.when(text.rlike("[0-9@+]"), F.md5("__text")).alias("__key"))
    rows = rows.withColumn("__found", F.when(text.rlike("[0-9@+]"), find_spans(text, TOKEN, context=True)))
    made = F.zip_with(
        "__found", touching(F.col("__found"), F.col("__base")),
        lambda t, seed: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), F.lower(t["match"]).alias("instance"), seed.alias("seed"),
            F.array(F.concat(F.lit("before "), _last(t["before"], 2)), F.concat(F.lit("around "), _last(t["before"], 1), F.lit(" _ "), _first(t["after"]))).alias("patterns"),
        ),
    )
    some = F.size("__found") > 0
    return rows.select(*names, "__base", F.when(some, made).alias("__tokens"), F.when(some, F.md5("__text")).alias("__key"))


def discover(found: DataFrame, scratch: Scratch, rounds: int, accept: float, support: int, digits: int) -> DataFrame:
    """Columns __key, __more: the places of new identifiers by text. `rounds` is the least number of rounds."""
    tokens = found.where("__key is not null").select("__key", F.explode("__tokens").alias("t")).select("__key", "t.*").distinct()
    tokens = scratch.write(tokens, "tokens")
    graph = tokens.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("times"))
    graph = scratch.write(graph, "graph")
    counts = [F.count("*").alias("n"), F.sum("times").alias("times")]
    scores = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("fixed"), *counts)
    scores = with_hot(scratch.write(scores, "seeds"), "n", "times")
    letters, numbers = F.length(F.regexp_replace("instance", r"[^\p{L}]", "")), F.length(F.regexp_replace("instance", "[^0-9]", ""))
    long_number = (numbers >= digits) & (numbers >= letters)
    sure = F.coalesce(F.col("confidence") >= SURE, F.lit(False))
    before, done = 0, 0
    while True:
        scored = join_unique(graph.select("pattern", "instance", "times"), scores.drop("fixed", "n", "times"), "instance", "inner")
        # The mean over the distinct instances, with one more that scores nothing for each `support`.
        mean = F.sum("score") / (F.count("*") + 1.0 / support)
        confidence = scored.groupBy("pattern").agg(F.least(mean, F.lit(0.999)).alias("confidence"), *counts).where(F.col("n") >= support)
        confidence = with_hot(scratch.write(confidence, "confidence"), "n", "times").drop("n", "times")
        supported = join_unique(graph, confidence, "pattern", "left").groupBy("instance").agg(
            F.max("seed").alias("fixed"), F.sum(F.log1p(-F.coalesce("confidence", F.lit(0.0)))).alias("log_not"),
            F.sum(F.when(sure, F.log1p(-F.col("confidence"))).otherwise(0.0)).alias("log_not_sure"), F.count_if(sure).alias("speak"), F.count_if(F.col("confidence") < SURE).alias("against"), *counts,
        )
        score = F.when(F.col("fixed"), 1.0).when(long_number, 1 - F.exp("log_not")).when(F.col("speak") >= F.col("against"), 1 - F.exp("log_not_sure")).otherwise(0.0)
        scores = with_hot(scratch.write(supported.select("instance", score.alias("score"), "fixed", "n", "times"), "scores"), "n", "times")
        # Scores never fall, so an equal count is an equal set.
        accepted, done = scores.where(~F.col("fixed") & (F.col("score") >= accept)).count(), done + 1
        if done >= rounds and accepted <= before:
            break
        before = accepted
    new = scores.where(~F.col("fixed") & (F.col("score") >= accept)).where(long_number | (letters > 0) | F.contains(F.col("instance"), F.lit("@"))).drop("score", "fixed", "n", "times")
    other = tokens.where(~F.col("seed"))
    said = join_unique(other.select("__key", "start", "end", F.explode("patterns").alias("pattern")), confidence.where(sure), "pattern", "inner").groupBy("__key", "start", "end").agg(F.sum(F.log1p(-F.col("confidence"))).alias("log_not"))
    places = join_unique(other.select("__key", "start", "end", "instance"), new, "instance", "inner").select("__key", "start", "end").union(said.where(1 - F.exp("log_not") >= accept).select("__key", "start", "end")).distinct()
    return places.groupBy("__key").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).cast(SPANS).alias("__more"))


def _with_more(found: DataFrame, keys: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """found with the places of new identifiers; the rows of a hot text (keys: one row each) are dealt by the partitions that they come from.

    more is a written table of the few texts that have some: its size is known, so the join broadcasts it only where it is small.
    """
    total = keys.count()
    # Rows without any token have no key and go past the join.
    rest = found.where("__key is null").withColumn("__more", F.array().cast(SPANS))
    found = found.where("__key is not null")
    hot = scratch.write(keys.where("__key is not null").groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") > max(total / HOT, HOT_ROWS)).select(F.col("__key").alias("__hot")), "hot")
    if is_empty(hot):
        out = found.join(more.withColumnRenamed("__key", "__k"), F.col("__key") == F.col("__k"), "left").drop("__k")
        return out.withColumn("__more", F.coalesce("__more", F.array().cast(SPANS))).unionByName(rest)
    hot = F.broadcast(hot)
    found = found.join(hot, F.col("__key") == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.spark_partition_id() % SALTS).otherwise(0))
    salts = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    more = more.join(hot, F.col("__key") == F.col("__hot"), "left").select(F.col("__key").alias("__k"), "__more", F.explode(salts).alias("__s"))
    out = found.join(more, (F.col("__key") == F.col("__k")) & (F.col("__salt") == F.col("__s")), "left").drop("__k", "__s", "__salt", "__hot")
    return out.withColumn("__more", F.coalesce("__more", F.array().cast(SPANS))).unionByName(rest)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, accept: float = 0.9, support: int = 4, digits: int = 7) -> DataFrame:
    """Columns id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context: one row per input row."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.write(_found(docs, text_col, [F.col(id_col).alias("id")]), "found")
    out = _with_more(found.drop("__tokens"), found.select("__key"), scratch.write(discover(found, scratch, rounds, accept, support, digits), "more"), scratch)
    return out.select(
        F.col("id").alias(id_col), *(counted("__base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(joined(F.col("__base"), KINDS), 256).alias("base_sha256"), joined(F.concat("__base", "__more"), KINDS).alias("spans"), F.size("__more").cast("long").alias("n_context"),
    )


def mask_pii(docs: DataFrame, text_col: str = "text", rounds: int = 2, accept: float = 0.9, support: int = 4, digits: int = 7) -> DataFrame:
    """The rows of docs with all their columns; in text_col every span is its kind in brackets, overlapping spans the first one's."""
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "pii")
    # Texts are never set aside: the base patterns run once for the bootstrap and once more where the texts are masked.
    found = scratch.write(_found(docs, text_col, []), "found")
    more = scratch.write(discover(found, scratch, rounds, accept, support, digits), "more")
    out = _with_more(_found(docs, text_col, [F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")], tokens=False), found.select("__key"), more, scratch)
    text = F.col(f"__row.`{text_col}`")
    out = out.withColumn("__spans", F.concat("__base", "__more"))
    masked = F.when(F.size("__spans") > 0, replaced(text.cast("string"), F.col("__spans"), [f"[{k.upper()}]" for k in KINDS])).otherwise(text)
    kind = docs.schema[text_col].dataType
    return out.select(*((masked.cast(kind) if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in names))
