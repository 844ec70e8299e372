"""The same claim with different numbers in different files: an inverted-index self-join and a matching of numbers."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import jaccard
from .findings import FLAGGED, findings
from .tables import written

MOST_POSTINGS, LEAST_SHARED, LEAST_SIMILARITY = 60, 3, 0.5
#: Shares of the claims that hold a token: at most so many tokens for each token of a claim are met by broadcast.
FREQUENT = 1000


def similar_claims(claims: DataFrame) -> DataFrame:
    """Pairs (a, b) of claims of different files, a before b, that share three tokens and half of all.

    Tokens in more than 60 claims are no evidence and make no pairs, which also bounds what a token can contribute.
    """
    # Read five times below: documents are split and numbers extracted once. The filter stands behind the table, since tokens would be made a second time for it.
    known = written(claims, "claims").where(F.size("tokens") >= LEAST_SHARED).withColumn("place", F.struct("rel", "line", "seq"))
    posted = known.select("claim_id", "rel", "place", F.explode("tokens").alias("token"))
    counts = written(posted.groupBy("token").agg(F.count("*").alias("n")), "tokens")
    # The most frequent tokens hold most postings, each of them in one task if it were shuffled; they are few and go before. A token of one claim makes no pair.
    frequent = counts.where(F.col("n") > F.greatest(F.lit(MOST_POSTINGS), F.lit(known.count() // FREQUENT))).select("token")
    rare = counts.where(F.col("n").between(2, MOST_POSTINGS)).select("token")
    posted = posted.join(F.broadcast(frequent), "token", "left_anti").join(rare, "token")
    left, right = (posted.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("claim_id", "rel", "place"))) for side in "ab")
    shared = left.join(right, "token").where("a_place < b_place and a_rel <> b_rel").groupBy("a_claim_id", "b_claim_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= LEAST_SHARED)
    side = lambda s: known.select(*(F.col(c).alias(f"{s}_{c}") for c in ("claim_id", "rel", "line", "sentence", "nums", "tokens")))
    return shared.join(side("a"), "a_claim_id").join(side("b"), "b_claim_id").withColumn("similarity", jaccard("a_tokens", "b_tokens")).where(F.col("similarity") >= LEAST_SIMILARITY)


def first_mismatch(a: list[dict], b: list[dict]) -> tuple[str, str] | None:
    """The first number of a, and of b, that are left when equal ones are paired off; None unless kinds agree."""
    if Counter(n["kind"] for n in a) != Counter(n["kind"] for n in b):
        return None
    free, left = list(b), []
    for n in a:
        def same(m: dict, n: dict = n) -> bool:
            if m["kind"] != n["kind"] or abs(abs(n["value"]) - abs(m["value"])) > 0.5 * 10.0 ** -min(n["decimals"], m["decimals"]) * 1.0001 + 1e-9:
                return False
            return n["den"] is None or (m["den"] is not None and abs(n["den"] - m["den"]) < 0.5)

        at = next((i for i, m in enumerate(free) if same(m)), None)
        if at is None:
            left.append(n)
        else:
            free.pop(at)
    return (left[0]["raw"], free[0]["raw"]) if left and free else None


@F.pandas_udf(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]))
def _mismatch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [first_mismatch(list(x), list(y)) or (None, None) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(found, columns=["a", "b"])


# Not to be moved: a filter on the result would be pushed below it, and the text read once for the filter and once for the result.
_mismatch = _mismatch.asNondeterministic()


def check_consistency(claims: DataFrame) -> DataFrame:
    """Findings: one flagged row for each similar pair whose numbers differ, at the earlier claim."""
    pairs = similar_claims(claims).withColumn("m", _mismatch("a_nums", "b_nums")).where("m.a is not null")
    message = F.concat(F.lit("says "), F.col("m.a"), F.lit(", but "), "b_rel", F.lit(":"), "b_line", F.lit(" says "), F.col("m.b"), F.lit(" in a similar sentence"))
    return findings(pairs, "consistency", FLAGGED, "a_rel", "a_line", message, F.concat(F.lit("A: "), F.substring("a_sentence", 1, 120), F.lit(" || B: "), F.substring("b_sentence", 1, 120)))
