"""Source text as token tables: absence, quotes and the passages that speak to a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quote_form
from .tables import written


def source_tokens(sources: DataFrame) -> DataFrame:
    """sources (ident, text) to (ident, token, n): lower-case letters and digits, hyphen compounds whole."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), 0)
    return sources.select("ident", F.explode(found).alias("token")).groupBy("ident", "token").agg(F.count("*").alias("n"))


def absent_terms(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """Terms (token) that no source has."""
    return terms.join(tokens.select("token").distinct(), "token", "left_anti")


def inverse_frequency(sentences: DataFrame, key: str, token: str = "token") -> DataFrame:
    """(token, df, idf): how many keys hold a token, and ln(1 + N / df)."""
    n = sentences.select(key).distinct().agg(F.count("*").alias("total"))
    df = sentences.select(key, token).distinct().groupBy(token).agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).withColumn("idf", F.log(1 + F.col("total") / F.col("df"))).drop("total")


def best_passages(claims: DataFrame, passages: DataFrame, k: int = 4, rare_share: float = 0.02) -> DataFrame:
    """claims (claim, token) and passages (passage, token), distinct: the k passages of most squared idf for each claim.

    Tokens in more than rare_share of the passages are common. Claims meet passages on rare tokens first; what the common ones can add is bounded, so
    common tokens are only looked up for the passages that may still be among the k best. Claims whose k-th score is below that bound meet on all tokens.
    Passages are read once and written; what is joined after that holds only tokens of claims, and steps that several joins read are written too.
    """
    passages = written(passages, "passages")
    total = passages.select("passage").distinct().count()
    passages = written(passages.join(claims.select("token").distinct(), "token", "left_semi"), "asked")
    idf = passages.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + F.lit(total) / F.col("df"))).withColumn("weight", F.pow("idf", F.lit(2.0)))
    asked = written(claims.join(idf, "token").select("claim", "token", "weight", (F.col("df") <= rare_share * total).alias("rare")), "weights")
    bound = asked.where("not rare").groupBy("claim").agg(F.sum("weight").alias("more"))
    met = asked.where("rare").join(passages, "token").groupBy("claim", "passage").agg(F.sum("weight").alias("score"), F.count("*").alias("shared")).join(bound, "claim", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    met = written(met, "met")
    place = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("score")))
    least = met.withColumn("place", place).where(F.col("place") == k).select("claim", F.col("score").alias("least"), "more")
    sure = least.where(F.col("least") > F.col("more") + 1e-9).select("claim", "least")
    near = written(met.join(sure, "claim").where(F.col("score") + F.col("more") >= F.col("least") - 1e-9).select("claim", "passage"), "near")
    # Both token and passage are keys here, so a token that all passages hold is no hot key.
    added = near.join(asked.where("not rare"), "claim").join(passages, ["passage", "token"]).select("claim", "passage", "weight")
    scored = near.join(asked.where("rare"), "claim").join(passages, ["passage", "token"]).select("claim", "passage", "weight").unionByName(added)
    open_claims = asked.join(sure.select("claim"), "claim", "left_anti")
    scored = scored.unionByName(open_claims.join(passages, "token").select("claim", "passage", "weight")).groupBy("claim", "passage").agg(F.sum("weight").alias("score"), F.count("*").alias("shared"))
    order = Window.partitionBy("claim").orderBy(F.desc(F.round("score", 9)), F.desc("passage"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def contained_quotes(quotes: DataFrame, texts: DataFrame, least_words: int = 6) -> DataFrame:
    """Pairs (quote_id, text_id) whose normal form holds the quote's, for quotes (quote_id, quote) and texts (text_id, text).

    Quote and text meet at the quote's word that fewest texts hold, not in a cross join; a quote with a word that no
    text holds meets none.
    """
    q = quotes.select("quote_id", quote_form("quote").alias("q")).where(F.size(F.split("q", " ")) >= least_words)
    held = texts.select("text_id", quote_form("text").alias("t"))
    words = q.select("quote_id", F.explode(F.array_distinct(F.split("q", " "))).alias("word"))
    spread = held.select("text_id", F.explode(F.array_distinct(F.split("t", " "))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    often = words.join(spread.groupBy("word").agg(F.count("*").alias("texts")), "word", "left").select("quote_id", F.coalesce("texts", F.lit(0)).alias("texts"), "word")
    rarest = often.groupBy("quote_id").agg(F.min(F.struct("texts", "word")).alias("m")).select("quote_id", F.col("m.word").alias("word"))
    met = rarest.join(spread, "word").select("quote_id", "text_id")
    return met.join(q, "quote_id").join(held, "text_id").where(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" ")))).select("quote_id", "text_id")
