"""What sources hold: one table of their tokens, the questions put to it, and whether an extraction can be trusted.

Each text is normalised and cut once, behind one shuffle by source, and the table is written; everything else is a join with it. A question (is this term, figure
or stem in that source?) has several readings, so it is taken apart into atoms, each a row that the table has or has not: a token of the
body, of the bibliography, a figure, half of a split word. One semi-join answers all atoms of all questions, and an expression over the
atoms found gives the answer. Two readings are not of whole tokens: beginnings are met on their first letters, a range of the sorted tokens;
letters without any blanks between them on six-letter grams, and only the few terms whose grams are all there are looked for in the letters themselves.
Everything here is in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fulltext import COMMON, figure_forms, normalize, words_in
from .tables import written

#: Letters that beginnings are met on (no shorter one is asked for), of a gram, and terms that are looked for in one source's letters at once.
STEM, GRAM, BATCH = 5, 6, 2_000
#: Kinds of rows of the index: tokens of the body, of its other readings, of the bibliography; figures; halves of words split over lines.
BODY, OTHER, REFS, FIGURE, HALF = "b", "o", "r", "f", "h"


def _parts(token: Column) -> Column:
    """Parts of a compound."""
    return F.when(F.contains(token, F.lit("-")), F.split(token, "-")).otherwise(F.array().cast("array<string>"))


def _runs(token: Column) -> Column:
    """Letters and digits apart."""
    return F.regexp_extract_all(token, F.lit("[a-z]+|[0-9]+"), 0)


def _joined(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z0-9]", "")


def source_texts(sources: DataFrame) -> DataFrame:
    """sources (ident, body, refs) to normal forms (ident, normal, cased, refs), dealt by source: what is read from here on is read once."""
    spaced = F.regexp_replace("body", "([a-z])([A-Z])", "$1 $2")
    return sources.select("ident", normalize("body").alias("normal"), normalize(spaced).alias("cased"), normalize("refs").alias("refs")).repartition("ident")


def index_texts(texts: DataFrame) -> DataFrame:
    """(ident, kind, token, n) of source_texts: how often each source has a token. Readings that only add tokens count where nothing else does."""
    rejoined = F.regexp_replace("normal", r"(?U)([a-z])-[\s\x1c-\x1f]+([a-z])", "$1$2")
    rows = lambda kind, found: F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
    halves = F.regexp_extract_all("normal", F.lit(r"([a-z]{4,})-[ \t]*\n"), 1)
    everything = F.concat(rows(BODY, words_in(F.col("normal"))), rows(OTHER, F.array_union(words_in(rejoined), words_in(F.col("cased")))), rows(REFS, words_in(F.col("refs"))), rows(FIGURE, figure_forms(F.col("normal"))), rows(HALF, halves))
    own = texts.select("ident", F.explode_outer(everything).alias("x")).where("x is not null").groupBy("ident", "x.kind", "x.token").agg(F.count("*").alias("n"))
    # Parts of compounds, and letters and digits of mixed words and parts, count as often as the words they are in.
    parts, mixed = _parts(F.col("token")), lambda p: p.rlike("[a-z]") & p.rlike("[0-9]")
    more = F.concat(F.array_distinct(parts), F.flatten(F.transform(F.filter(F.concat(F.array("token"), parts), mixed), lambda p: F.array_distinct(_runs(p)))))
    each = own.select("ident", "kind", F.explode_outer(F.when(F.col("kind") == BODY, F.concat(F.array("token"), more)).otherwise(F.array("token"))).alias("token"), "n")
    body = F.col("kind").isin(BODY, OTHER)
    counted = each.groupBy("ident", F.when(body, BODY).otherwise(F.col("kind")).alias("kind"), "token").agg(F.sum(F.when(F.col("kind") != OTHER, F.col("n"))).alias("n"))
    return counted.select("ident", "kind", "token", F.coalesce("n", F.lit(1)).alias("n"))


def _readings(nf: Column) -> Column:
    """What speaks for a form, given as its normal form: its words, what is left of it without a ligature, all its letters."""
    without = F.transform(F.filter(F.array(*map(F.lit, ("ffi", "ffl", "fi", "fl", "ff"))), lambda x: F.contains(nf, x)), lambda x: words_in(F.replace(nf, x, F.lit(""))))
    return F.struct(words_in(nf).alias("words"), F.filter(without, lambda w: F.size(w) > 0).alias("without"), _joined(nf).alias("letters"))


def _atom(kind: str, token: Column) -> Column:
    return F.concat(F.lit(kind + ":"), token)


def _ask(what: Column, kind: Column) -> Column:
    """The forms of a question of which enough must be held."""
    t = F.lower(what)
    whole = F.filter(F.split(t, "-"), lambda p: p.rlike("^[a-z]{4,}$"))
    return F.when(kind.isin("figure", "stem"), F.array().cast("array<string>")).when(kind == "compound", F.concat(whole, F.array(t))).when(kind == "alnum", F.array(t)).otherwise(F.array(t, F.regexp_replace(t, "s+$", ""), F.concat(t, F.lit("s"))))


def _answer(found: Column) -> Column:
    """Whether the atoms found answer the question, for rows with what, kind and forms (array of _readings)."""
    has = lambda kind: lambda w: F.array_contains(found, _atom(kind, w))
    all_of = lambda words: (F.size(words) > 0) & F.forall(words, has(BODY))
    beginnings = lambda f: F.exists(found, lambda a: a.startswith(HALF + ":") & (F.length(f["letters"]) > F.length(a) - 2) & F.startswith(f["letters"], F.substring(a, F.lit(3), F.length(a))))
    held = lambda f: all_of(f["words"]) | F.exists(f["words"], has(REFS)) | F.exists(f["without"], all_of) | beginnings(f) | F.array_contains(found, _atom("s", f["letters"]))
    forms = F.col("forms")
    last = F.slice(forms, -1, 1)
    compound = (F.size(forms) == 1) | F.forall(F.slice(forms, 1, F.size(forms) - 1), held) | F.exists(last, held)
    pieces = _runs(F.lower("what"))
    alnum = F.exists(forms, held) | ((F.size(pieces) > 1) & F.forall(pieces, has(BODY)))
    kind = F.col("kind")
    return F.when(kind == "figure", F.array_contains(found, _atom(FIGURE, F.col("what")))).when(kind == "compound", compound).when(kind == "alnum", alnum).otherwise(F.exists(forms, held))


def _grams(letters: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(letters, F.lit(f"(?=([a-z0-9]{{{GRAM}}}))"), 1))


def held_letters(terms: DataFrame, letters: DataFrame) -> DataFrame:
    """terms (ident, letters), distinct and six letters long at least, that the source's own letters hold somewhere, blanks and signs aside."""
    grams = terms.select("ident", "letters", F.explode(_grams(F.col("letters"))).alias("gram"))
    asked = grams.select("ident", "gram").distinct()
    sizes = asked.groupBy("ident").agg(F.ceil(F.count("*") / (BATCH * GRAM)).alias("batches"))
    batch = asked.join(sizes, "ident").groupBy("ident", F.pmod(F.xxhash64("gram"), F.col("batches")).alias("batch")).agg(F.collect_set("gram").alias("wanted"))
    own = letters.select("ident", F.col("letters").alias("own"))
    there = batch.join(own, "ident").select("ident", F.explode(F.array_intersect(_grams(F.col("own")), "wanted")).alias("gram"))
    met = grams.join(there, ["ident", "gram"]).groupBy("ident", "letters").agg(F.count("*").alias("met")).where(F.col("met") == F.size(_grams(F.col("letters"))))
    # Grams may be there in another order, so what they leave is looked for as a whole.
    left = met.groupBy("ident").agg(F.ceil(F.count("*") / BATCH).alias("batches"))
    few = met.join(left, "ident").groupBy("ident", F.pmod(F.xxhash64("letters"), F.col("batches")).alias("batch")).agg(F.collect_list("letters").alias("terms"))
    return few.join(own, "ident").select("ident", F.explode(F.filter("terms", lambda t: F.contains(F.col("own"), t))).alias("letters"))


def ask_index(questions: DataFrame, texts: DataFrame, index: DataFrame) -> DataFrame:
    """questions (ident, what, kind), distinct, with present; index is index_texts(texts)."""
    forms = written(questions.withColumn("forms", F.transform(F.transform(_ask(F.col("what"), F.col("kind")), normalize), _readings)).withColumn("q", F.struct("what", "kind")), "forms")
    f = F.col("forms")
    words = F.concat(F.flatten(f["words"]), F.flatten(F.flatten(f["without"])), F.when(F.col("kind") == "alnum", _runs(F.lower("what"))).otherwise(F.array().cast("array<string>")))
    halves = F.flatten(F.transform(f["letters"], lambda x: F.transform(F.filter(F.sequence(F.lit(4), F.greatest(F.length(x), F.lit(4))), lambda i: i < F.length(x)), lambda i: F.substring(x, F.lit(1), i))))
    named = lambda kind, tokens: F.transform(tokens, lambda t: _atom(kind, t))
    atoms = F.concat(named(BODY, words), named(REFS, F.flatten(f["words"])), named(HALF, halves), named("s", F.filter(f["letters"], lambda x: F.length(x) >= GRAM)), F.when(F.col("kind") == "figure", F.array(_atom(FIGURE, F.col("what")))).otherwise(F.array().cast("array<string>")))
    # Outer explodes: the filter that a plain one implies would be pushed below the forms, expression in expression.
    asked = forms.where("kind <> 'stem'").select("ident", "q", F.explode_outer(F.array_distinct(atoms)).alias("atom")).where("atom is not null")
    terms = asked.where(F.startswith("atom", F.lit("s:"))).select("ident", F.substring(F.col("atom"), F.lit(3), F.length("atom")).alias("letters")).distinct()
    held = held_letters(terms, texts.select("ident", _joined(F.col("normal")).alias("letters")))
    holds = index.select("ident", F.concat_ws(":", "kind", "token").alias("atom")).unionByName(held.select("ident", _atom("s", F.col("letters")).alias("atom")))
    found = asked.join(holds, ["ident", "atom"], "left_semi").groupBy("ident", "q").agg(F.collect_set("atom").alias("found"))
    answered = forms.where("kind <> 'stem'").join(found, ["ident", "q"], "left").withColumn("present", _answer(F.coalesce("found", F.array().cast("array<string>"))))
    # Beginnings: the tokens of the range that share their first letters, summed up.
    stems = questions.where("kind = 'stem'").select("ident", "what", F.substring("what", 1, STEM).alias("first"))
    tokens = index.where(F.col("kind") == BODY).select("ident", F.substring("token", 1, STEM).alias("first"), "token", "n")
    sums = stems.join(tokens, ["ident", "first"]).where(F.startswith("token", F.col("what"))).groupBy("ident", "what").agg(F.sum("n").alias("n"))
    stemmed = questions.where("kind = 'stem'").join(sums, ["ident", "what"], "left").select("ident", "what", "kind", (F.coalesce("n", F.lit(0)) >= 2).alias("present"))
    return answered.select("ident", "what", "kind", "present").unionByName(stemmed)


def ask_sources(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """questions (pair_id, ident, what, kind) with present, answered by the texts of trusted sources; null where there is none."""
    texts = written(source_texts(sources.where("trusted")), "source-texts")
    index = written(index_texts(texts), "source-index")
    asked = written(questions.select("ident", "what", "kind").distinct().join(texts.select("ident").distinct(), "ident", "left_semi"), "questions")
    return questions.join(ask_index(asked, texts, index), ["ident", "what", "kind"], "left")


def self_check(rows: DataFrame) -> DataFrame:
    """rows (ident, title, abstract, body, refs, plain, closed and others) with why: what speaks against the extraction of each; empty if nothing does.

    plain is the text that words are cut from; closed says whether the end of the document was seen; pages and failed, where there are such columns, how many
    pages it has and how many of them could not be read.
    """
    index = written(index_texts(source_texts(rows)), "source-index").where(F.col("kind") == BODY)
    total = index.groupBy("ident").agg(F.sum("n").alias("total"))
    telling = lambda text, least: F.array_distinct(F.filter(words_in(normalize(text)), lambda w: (F.length(w) >= least) & ~w.isin(*COMMON)))
    asked = rows.select("ident", F.explode_outer(F.concat(
        F.transform(telling("title", 4), lambda w: F.struct(F.lit("title").alias("of"), w.alias("word"))), F.transform(F.filter(telling("abstract", 6), lambda w: ~F.contains(w, F.lit("-"))), lambda w: F.struct(F.lit("abstract").alias("of"), w.alias("word"))),
    )).alias("x")).where("x is not null").select("ident", "x.*")
    met = asked.join(index.select("ident", F.col("token").alias("word"), "n"), ["ident", "word"], "left")
    rate = lambda of: (F.count(F.when(F.col("of") == of, 1)).alias(f"{of}_words"), F.count(F.when((F.col("of") == of) & F.col("n").isNotNull(), 1)).alias(f"{of}_found"))
    rates = met.groupBy("ident").agg(*rate("title"), *rate("abstract"))
    zero = F.lit(0).cast("long")
    found = rows.join(total, "ident", "left").join(rates, "ident", "left").fillna(0, ["total", "title_words", "title_found", "abstract_words", "abstract_found"])
    plain = F.coalesce("plain", F.lit(""))
    words = words_in(normalize(plain))
    letters = F.size(F.filter(words, lambda w: w.rlike("^[b-hj-z]$")))
    share = lambda a, b: F.round(100 * a / F.greatest(b, zero + 1), 1).cast("string")
    short = lambda of, least, needed: (F.col(f"{of}_words") >= least) & (F.col(f"{of}_found") < needed * F.col(f"{of}_words"))
    strange = F.length(plain) - F.length(F.replace(plain, F.lit("�"), F.lit("")))
    rules = [
        (F.col("total") < 1500, F.concat(F.col("total").cast("string"), F.lit(" words are too few for a full text"))),
        (strange > 0.005 * F.length(plain), F.concat(share(strange, F.length(plain)), F.lit(" % of its signs are unreadable"))),
        (letters > 0.2 * F.size(words), F.concat(share(letters, F.size(words)), F.lit(" % of its words are lone letters"))),
        (short("abstract", 8, 0.95), F.concat(F.lit("its abstract is in it to "), share(F.col("abstract_found"), F.col("abstract_words")), F.lit(" % only"))),
        (short("title", 2, 0.75), F.concat(F.lit("its title is in it to "), share(F.col("title_found"), F.col("title_words")), F.lit(" % only"))),
        (F.col("title_words") + F.col("abstract_words") == 0, F.lit("neither title nor abstract is known to compare it with")),
        (~F.col("closed"), F.lit("its end is missing")),
    ]
    if "pages" in rows.columns:
        rules.append((F.col("total") < 100 * F.col("pages"), F.lit("its pages hold hardly any words")))
    if "failed" in rows.columns:
        rules.append((F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" pages are unread"))))
    why = F.array_compact(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), said) for wrong, said in rules)))
    return found.withColumn("why", why).select(*rows.columns, "why")


def token_bags(sources: DataFrame) -> DataFrame:
    """(ident, counts, ref_counts, figures, halves) of sources (ident, body, refs): what is kept of a text that may not be kept itself."""
    index = index_texts(source_texts(sources))
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("token", "n")))
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("token"))))
    bags = index.groupBy("ident").agg(F.map_from_entries(of(BODY)).alias("counts"), F.map_from_entries(of(REFS)).alias("ref_counts"), names(FIGURE).alias("figures"), names(HALF).alias("halves"))
    empty = F.create_map().cast("map<string,bigint>")
    none = F.array().cast("array<string>")
    return sources.select("ident").join(bags, "ident", "left").select("ident", F.coalesce("counts", empty).alias("counts"), F.coalesce("ref_counts", empty).alias("ref_counts"), F.coalesce("figures", none).alias("figures"), F.coalesce("halves", none).alias("halves"))
