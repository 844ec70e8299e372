"""The registered queries of the audit engine and the SQL that each is held against.

Documents of the test tables state few numbers, so claims are derived from the star-schema tables: the same SQL, run by
either engine, writes sentences, tags and data tables with known errors. Table names stand in braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS, DOT, STOP_WORDS, sentences, tokens
from ..operators import arithmetic, budget, citation, collected, consistency, findings, json_index, judge, mentions, overclaim, passages, registry, source_check, support, values
from ..operators.sentences import extract_claims, split_documents
from ..sources import answers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query and its SQL; table names in braces become plain names."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", oracle)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def generated(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts below, over the tables it names in braces."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


#: A key as letters, so that sentences of different keys share no token.
def _word(key: str) -> str:
    return f"translate(cast({key} as string), '0123456789', 'abcdefghij')"


def _re2_sentences(column: str) -> str:
    text = column
    for a in ABBREVIATIONS:
        text = f"replace({text}, '{a}', '{a.replace('.', DOT)}')"
    return f"string_split(regexp_replace({text}, '([.!?])\\s+([A-Z(\\[\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


# ---------------------------------------------------------------- text
@query("sentence_split", f"""
select doc_id, count(*) as n_sentences, cast(sum(length(s)) as bigint) as n_chars, max(length(s)) as longest
from (select doc_id, trim(replace(unnest({_re2_sentences("text")}), '{DOT}', '.')) as s from {{documents}}) where s <> '' group by doc_id""")  # fmt: skip
def _sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"), F.max(F.length("s")).alias("longest"))


_PROTECTED = "p"
for _a in ABBREVIATIONS:
    _PROTECTED = f"replace({_PROTECTED}, '{_a}', '{_a.replace('.', DOT)}')"


_UNITS = rf"""
with clean as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?s:<!--.*?-->)|(?s:```.*?```)|`[^`\n]*`', ' ', 'g'), '!?\[([^\]]*)\]\([^)]*\)|[*_]{{1,3}}([^*_\n]+)[*_]{{1,3}}', '\1\2', 'g'),
'!?\[([^\]]*)\]\([^)]*\)|[*_]{{1,3}}([^*_\n]+)[*_]{{1,3}}', '\1\2', 'g') as text from {{documents}} where text is not null),
lines as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as n from clean),
cut as (select doc_id, n, regexp_replace(s, '^\s+|\s+$', '', 'g') as s from lines),
kinds as (select *, case when s like '|%' and length(s) - length(replace(s, '|', '')) >= 2 then case when regexp_full_match(s, '\|?[\s:|-]+\|?') then 'rule' else 'row' end
when regexp_matches(s, '^#{{1,6}}\s') then 'heading' when s <> '' and not regexp_full_match(s, '[-=]{{3,}}') then 'prose' else 'gap' end as kind from cut),
runs as (select *, sum(case when kind = before then 0 else 1 end) over (partition by doc_id order by n) as run from (select *, lag(kind) over (partition by doc_id order by n) as before from kinds)),
parts as (select doc_id, n, kind, case when kind = 'prose' then run else -n end as unit, case kind when 'heading' then trim(regexp_replace(s, '^#+', '')) when 'prose' then regexp_replace(s, '^([-*+]|\d+[.)])\s+', '') else s end as s from runs where kind in ('row', 'heading', 'prose')),
places as (select *, sum(length(s) + 1) over (partition by doc_id, unit order by n) - length(s) - 1 as at from parts),
units as (select doc_id, unit, min(n) as line, string_agg(s, ' ' order by n) as p from parts group by doc_id, unit),
pieces as (select doc_id, unit, line, unnest(string_split(x, chr(1))) as piece, generate_subscripts(string_split(x, chr(1)), 1) as i from (select doc_id, unit, line, regexp_replace({_PROTECTED}, '([.!?])(\s+)([A-Z(\["''])', '\1\2' || chr(1) || '\3', 'g') as x from units)),
begun as (select *, sum(length(piece)) over (partition by doc_id, unit order by i) - length(piece) as begin from pieces),
made as (select b.doc_id, b.unit, b.i, b.line + (select count(*) from places p where p.doc_id = b.doc_id and p.unit = b.unit and p.at > 0 and p.at <= b.begin) as line, regexp_replace(replace(piece, '{DOT}', '.'), '^\s+|\s+$', '', 'g') as sentence, b.line as first from begun b)
select concat('d/', doc_id, '.md') as rel, cast(line as int) as line, cast(row_number() over (partition by doc_id order by first, i) - 1 as int) as seq, sentence from made where sentence <> ''"""


@query("unit_assembly", _UNITS)
def _unit_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("rel"), "text"))


@query("unit_assembly_in_pieces", _UNITS)
def _unit_assembly_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document dealt over tasks in pieces of a few lines."""
    return split_documents(table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("rel"), "text"), long=-1, chunk=5)


@query("token_counts", f"""
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z]{{2,}}')) as w from {{documents}}),
t as (select doc_id, case when w like '%s' and length(w) > 4 then left(w, -1) else w end as token from w)
select token, count(*) as n_docs from (select distinct doc_id, token from t) where token not in ({", ".join(f"'{w}'" for w in STOP_WORDS)}) group by token""")  # fmt: skip
def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))


@query("context_lag", """
select conv_id, turn, role, lag(text) over (partition by conv_id order by turn) as context from {conversations}""")
def _context_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("text").over(order).alias("context"))


# ---------------------------------------------------------------- overclaim
WORDING = """
select c_custkey, concat('c/', cast(c_custkey as string), '.md') as rel,
concat('Our ', lower(c_mktsegment), ' plan ', case c_custkey % 12 when 0 then 'always wins' when 1 then 'is not a guarantee' when 2 then 'is a novel idea' when 3 then 'clearly helps everyone'
when 4 then 'was the first to grow' when 5 then 'came first in May' when 6 then 'is the best ever' when 7 then 'did its best in May' when 8 then 'beats all rivals' when 9 then 'beats some rivals'
when 10 then 'offers proof' else 'grew' end, '.') as text from {customer}"""


@query("overclaim_flags", f"""
with w as ({WORDING}) select rel as file, 1 as line, category, word, negated from w join (values (0, 'absolute', 'always', false), (1, 'guarantee', 'guarantee', true), (2, 'novelty claim', 'novel', false),
(3, 'certainty word', 'clearly', false), (3, 'universal claim', 'everyone', false), (4, 'priority claim', 'first', false), (6, 'superiority claim', 'best', false), (8, 'superiority claim', 'beats', false),
(10, 'proof language', 'proof', false)) as x(k, category, word, negated) on c_custkey % 12 = k""")  # fmt: skip
def _overclaim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overclaim.find_overclaims(split_documents(generated(spark, sf_dir, WORDING)))
    return found.select(F.col("rel").alias("file"), "line", "category", "word", "negated")


@query("overclaim_summary", f"""
with w as ({WORDING}) select 'overclaim' as check, count(*) filter (c_custkey % 12 in (0, 1, 2, 4, 6, 8, 10)) + 2 * count(*) filter (c_custkey % 12 = 3) as flagged, 0 as verified, 0 as unverifiable from w
union all select 'seeds', 0, 0, 0""")  # fmt: skip
def _overclaim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(overclaim.check_overclaims(split_documents(generated(spark, sf_dir, WORDING))), ["overclaim", "seeds"])


@query("overclaim_words", """
select doc_id, """ + ", ".join(
    f"""cast(len(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words})(?:$|[^\\p{{L}}\\p{{N}}_])')) as int) as {name}"""
    for name, words in (("best", "best"), ("absolutes", "always|never"), ("the_word", "the"))
) + " from {documents}")
def _overclaim_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda w: F.regexp_count("text", F.lit(rf"(?U)(?i)\b(?:{w})\b"))
    return table(spark, sf_dir, "documents").select("doc_id", count("best").alias("best"), overclaim.word_count(F.col("text"), "absolute").alias("absolutes"), count("the").alias("the_word"))


# ---------------------------------------------------------------- value index
_NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "part": ["p_size", "p_retailprice"]}


def _numeric_oracle() -> str:
    parts = []
    for t, columns in _NUMERIC.items():
        for c in columns:
            x, where = f"cast({c} as double)", f"from {{{t}}}"
            unit = f"(select bool_and({x} between 0 and 1) and not bool_and({x} in (0, 1)) {where})"
            for what, agg in (("count", "count(*)"), ("mean", f"avg({x})"), ("median", f"median({x})"), ("min", f"min({x})"), ("max", f"max({x})"), ("sum", f"sum({x})"), ("std", f"stddev_samp({x})")):
                parts.append(f"select '{t}' as file, '{c}' as header, '{what}' as what, round(cast({agg} as double), 4) as value {where}")
                if what in ("mean", "median", "min", "max"):
                    parts.append(f"select '{t}', '{c}', '{what} x100', round(100 * {agg}, 4) {where} having {unit}")
    return " union all ".join(parts)


@query("value_index_numeric", _numeric_oracle())
def _value_index_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [values.unpivot(table(spark, sf_dir, t).select(*c), t) for t, c in _NUMERIC.items()]
    return values.numeric_aggregates(cells[0].unionByName(cells[1])).select("file", "header", "what", F.round("value", 4).alias("value"))


@query("value_index_categorical", """
select 'orders' as file, 'o_orderstatus' as header, o_orderstatus as raw, count(*) as n from {orders} group by o_orderstatus
union all select 'orders', 'o_orderpriority', o_orderpriority, count(*) from {orders} group by o_orderpriority""")
def _value_index_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.category_counts(values.unpivot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "orders"))


@query("column_type_vote", """
select 'p_name' as header, count(*) as cells, 0::bigint as numeric_cells, count(distinct p_name) as distinct_cells, false as is_numeric from {part}
union all select 'p_size', count(*), count(*), count(distinct p_size), true from {part}
union all select 'p_brand', count(*), 0, count(distinct p_brand), false from {part}""")
def _column_type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.column_types(values.unpivot(table(spark, sf_dir, "part").select("p_name", "p_size", "p_brand"), "part")).drop("file")


@query("unpivot_cells", """
select 'n_name' as header, n_name as raw, n_name as label from {nation} union all select 'n_regionkey', cast(n_regionkey as varchar), n_name from {nation}""")
def _unpivot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.unpivot(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "nation", F.col("n_name")).select("header", "raw", "label")


# ---------------------------------------------------------------- claims and sources
TOTALS = f"""
select concat({_word("c_nationkey")}, 'x ', lower(c_mktsegment)) as market, cast(sum(cast(c_acctbal as decimal(18, 2))) as string) as account_total, count(*) as customer_count,
cast(c_nationkey as int) as k from {{customer}} group by c_nationkey, c_mktsegment"""
CLAIMS = f"""
select concat('paper/', cast(k as string), '.md') as rel, k, market,
concat('The account_total of ', market, ' is ', cast(cast(account_total as decimal(18, 2)) + case when k % 5 = 0 then 1234567.89 else 0 end as string), '.') as text from ({TOTALS}) t"""


@query("claim_numbers", f"""
with t as ({TOTALS}) select market, cast(cast(account_total as decimal(18, 2)) + case when k % 5 = 0 then 1234567.89 else 0 end as double) as value, 'plain' as kind, 2 as decimals from t""")
def _claim_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = generated(spark, sf_dir, CLAIMS).select("market", "text").withColumn("rel", F.concat("market", F.lit(".md")))
    n = extract_claims(split_documents(claims)).select(F.regexp_replace("rel", r"\.md$", "").alias("market"), F.explode("nums").alias("n"))
    return n.select("market", F.col("n.value").alias("value"), F.col("n.kind").alias("kind"), F.col("n.decimals").alias("decimals"))


@query("source_band_join", """
select c_custkey, s_suppkey from {customer} join {supplier} on abs(s_acctbal - round(c_acctbal, 0)) <= 0.5 * 1.0001 + 1e-9 * greatest(1, abs(round(c_acctbal, 0)))""")
def _source_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 0).alias("target")).withColumn("tol", source_check.band(F.lit(0), F.col("target")))
    held = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("value"))
    return source_check.band_join(wanted, held).select("c_custkey", "s_suppkey")


def _claims_and_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = generated(spark, sf_dir, TOTALS).drop("k")
    docs = generated(spark, sf_dir, CLAIMS).select(F.concat("rel", F.lit("/"), "market").alias("rel"), "text")
    return extract_claims(split_documents(docs)), values.index_table(data, "data/market_totals.csv", "market"), values.file_info(data, "data/market_totals.csv")


_STATUS = f"""
with t as ({TOTALS}), v as (select cast(account_total as double) as v from t union all select avg(cast(account_total as double)) from t union all select median(cast(account_total as double)) from t
union all select sum(cast(account_total as double)) from t union all select stddev_samp(cast(account_total as double)) from t union all select cast(customer_count as double) from t),
c as (select market, k, cast(account_total as double) + case when k % 5 = 0 then 1234567.89 else 0 end as stated from t)
select market, case when exists (select 1 from v where abs(v - stated) <= 0.005 * 1.0001 + 1e-9 * greatest(1, abs(stated))) then 'VERIFIED' else 'FLAGGED' end as status from c"""


@query("source_verdicts", _STATUS)
def _source_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_check.check_sources(*_claims_and_index(spark, sf_dir))
    return found.select(F.element_at(F.split("file", "/"), -1).alias("market"), "status")


@query("nearest_two", f"""
with t as ({TOTALS}), c as (select market, cast(account_total as double) + 1234567.89 as stated from t where k % 5 = 0), n as (select c.market, t.market as near_market, row_number() over (partition by c.market order by abs(cast(account_total as double) - stated), cast(account_total as double)) as place
from c, t) select market, near_market, place from n where place <= 2""")  # fmt: skip
def _nearest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, index, files = _claims_and_index(spark, sf_dir)
    cells = index.where(F.startswith("where", F.lit("account_total [")))
    refs = source_check.referenced_files(claims, files)
    flagged = source_check.number_verdicts(claims, cells, refs).where("status = 'FLAGGED'")
    near = source_check.nearest_two(flagged, refs, cells).join(claims.select("claim_id", "rel"), "claim_id")
    return near.select(F.element_at(F.split("rel", "/"), -1).alias("market"), F.regexp_extract("near_where", r"\[(.*)\]", 1).alias("near_market"), "place")


# ---------------------------------------------------------------- consistency
STATED = f"""
select concat(f, '/', cast(c_custkey as string), '.md') as rel, c_custkey, f, concat('Group ', w, 'qa ', w, 'zo ', w, 'vu counted ', cast(1000 + c_custkey % 700 + case when f = 'b' and c_custkey % 4 = 0 then 7 else 0 end as string), ' orders.') as text
from (select c_custkey, {_word("c_custkey")} as w, f from {{customer}} cross join (select 'a' as f union all select 'b') x) y"""


@query("consistency_pairs", "select c_custkey, 1.0::double as similarity from {customer}")
def _consistency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = consistency.similar_claims(extract_claims(split_documents(generated(spark, sf_dir, STATED))))
    return pairs.select(F.regexp_extract("a_rel", r"(\d+)\.md", 1).cast("long").alias("c_custkey"), "similarity")


@query("consistency_mismatch", """
select concat('a/', c_custkey, '.md') as file, 1 as line, concat('says ', 1000 + c_custkey % 700, ', but b/', c_custkey, '.md:1 says ', 1007 + c_custkey % 700, ' in a similar sentence') as message from {customer} where c_custkey % 4 = 0
and not (1000 + c_custkey % 700 between 1900 and 2100 or 1007 + c_custkey % 700 between 1900 and 2100)""")  # fmt: skip
def _consistency_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.check_consistency(extract_claims(split_documents(generated(spark, sf_dir, STATED)))).select("file", "line", "message")


# ---------------------------------------------------------------- registry
TAGGED = """
select concat('r/', cast(s_suppkey as string), '.md') as rel, s_suppkey, concat('The balance is ', cast(cast(s_acctbal + case s_suppkey % 6 when 1 then 3 else 0 end as decimal(18, 1)) as string), '<!-- claim: bal_', cast(s_suppkey as string), ' = ',
cast(cast(s_acctbal + case s_suppkey % 6 when 2 then 5 else 0 end as decimal(18, 2)) as string), ' -->.', case s_suppkey % 6 when 5 then '\n<!-- claim: broken -->' else '' end) as text from {supplier}"""
ENTRIES = """
select concat('bal_', cast(s_suppkey as string)) as label, cast(cast(s_acctbal as decimal(18, 2)) as string) as value, cast(null as string) as tolerance, '' as how from {supplier} where s_suppkey % 6 <> 3
union all select concat('bal_', cast(s_suppkey as string)), '1', null, '' from {supplier} where s_suppkey % 6 = 4 union all select concat('spare_', cast(n_nationkey as string)), '1.5', null, '' from {nation}"""


@query("registry_verdicts", """
select concat('r/', s_suppkey, '.md') as rel, 1 as line, case s_suppkey % 6 when 1 then 'prose differs' when 2 then 'prose differs' when 3 then 'missing' when 4 then 'unusable entry' else 'matches' end as rule from {supplier}
union all select concat('r/', s_suppkey, '.md'), 2, 'unread tag' from {supplier} where s_suppkey % 6 = 5""")  # fmt: skip
def _registry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = registry.find_tags(generated(spark, sf_dir, TAGGED))
    return registry.judge_tags(tags, generated(spark, sf_dir, ENTRIES)).select("rel", "line", "rule")


@query("registry_unused", "select concat('spare_', n_nationkey) as label from {nation}")
def _registry_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.unused_entries(registry.find_tags(generated(spark, sf_dir, TAGGED)), generated(spark, sf_dir, ENTRIES))


@query("registry_summary", """
select 'registry' as check, count(*) filter (s_suppkey % 6 in (0, 5)) as verified, count(*) filter (s_suppkey % 6 in (1, 2, 3)) as flagged,
count(*) filter (s_suppkey % 6 = 5) + 2 * count(*) filter (s_suppkey % 6 = 4) + (select count(*) from {nation}) as unverifiable from {supplier}""")
def _registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(registry.check_registry(generated(spark, sf_dir, TAGGED), generated(spark, sf_dir, ENTRIES), "claims.csv"), ["registry"])


# ---------------------------------------------------------------- arithmetic
COMPARED = """
select concat('m/', cast(o_orderkey as string), '.md') as rel, o_orderkey, concat('The rate went from ', cast(a as string), '.0 to ', cast(a + d as string), '.0, a gain of ', cast(d + case when o_orderkey % 7 = 0 then 2 else 0 end as string), '.0 points.') as text
from (select o_orderkey, 20 + o_orderkey % 40 as a, 3 + o_orderkey % 11 as d from {orders}) t"""
COMPARED_RELATIVE = """
select concat('m/', cast(p_partkey as string), '.md') as rel, p_partkey, concat('Accuracy reaches ', cast(a as string), '.0 versus ', cast(a * 2 as string), '.0, a ', cast(case when p_partkey % 9 = 0 then 13 when p_partkey % 2 = 0 then 50 else 100 end as string), '% relative improvement.') as text
from (select p_partkey, 15 + p_partkey % 20 as a from {part}) t"""


@query("benchmark_absolute", "select concat('m/', o_orderkey, '.md') as file, case when o_orderkey % 7 = 0 then 'FLAGGED' else 'VERIFIED' end as status from {orders}")
def _benchmark_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arithmetic.check_benchmarks(split_documents(generated(spark, sf_dir, COMPARED))).select("file", "status")


@query("benchmark_relative", "select concat('m/', p_partkey, '.md') as file, case when p_partkey % 9 = 0 then 'FLAGGED' else 'VERIFIED' end as status from {part}")
def _benchmark_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arithmetic.check_benchmarks(split_documents(generated(spark, sf_dir, COMPARED_RELATIVE))).select("file", "status")


SEEDED = """
select concat('s/', cast(p_partkey as string), '.md') as rel, p_partkey, concat('We ran over ', case when p_partkey % 5 = 0 then '4' else '3' end, ' seeds: ', cast(a as string), '.1, ', cast(a + 1 as string), '.1, ', cast(a + 2 as string), '.1, mean ',
cast(a + case when p_partkey % 3 = 0 then 6 else 1 end as string), '.1 ± ', case when p_partkey % 4 = 0 then '9.0' else '1.0' end, '.') as text from (select p_partkey, 40 + p_partkey % 30 as a from {part}) t"""


@query("seeds_rules", """
select concat('s/', p_partkey, '.md') as file, 'mean' as rule, case when p_partkey % 3 = 0 then 'FLAGGED' else 'VERIFIED' end as status from {part}
union all select concat('s/', p_partkey, '.md'), 'count', 'FLAGGED' from {part} where p_partkey % 5 = 0 union all select concat('s/', p_partkey, '.md'), 'spread', 'FLAGGED' from {part} where p_partkey % 4 = 0""")
def _seeds_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arithmetic.find_seed_rows(split_documents(generated(spark, sf_dir, SEEDED))).select(F.col("rel").alias("file"), "rule", "status")


#: What a spread may be: an error, a half-width or a deviation, named by the words around it; seed numbers; bars that overlap, with and without a test.
_RUNS = [
    ("Results over 4 runs: %1$d.0, %2$d.0, %3$d.0, %4$d.0, mean %2$d.5 ± 0.65 (SEM).", [("mean", "VERIFIED")]), ("Results over 4 runs: %1$d.0, %2$d.0, %3$d.0, %4$d.0, mean %2$d.5 ± 1.29 (SEM).", [("mean", "VERIFIED"), ("spread", "FLAGGED")]),
    ("Results over 4 runs: %1$d.0, %2$d.0, %3$d.0, %4$d.0, mean %2$d.5 ± 2.05 (95%% CI).", [("mean", "VERIFIED")]), ("Results over 4 runs: %1$d.0, %2$d.0, %3$d.0, %4$d.0, mean %2$d.5 ± 0.65 as standard deviation.", [("mean", "VERIFIED"), ("spread", "FLAGGED")]),
    ("Results over 3 seeds: %1$d, %2$d, %3$d, mean %2$d.5 ± 0.6.", [("identifiers", "UNVERIFIABLE")]), ("The gain is significant: %4$d.2 ± 0.9 versus %4$d.6 ± 0.4 over 5 runs.", [("significance", "UNVERIFIABLE")]),
    ("Over 4 runs the standard deviation is 2.0 and the standard error is 1.5 around %1$d.", [("error", "FLAGGED")]), ("Over 4 runs the standard deviation is 2.0 and the standard error is 1.0 around %1$d.", []),
    ("By a t-test the gain is significant: %4$d.2 ± 0.9 versus %4$d.6 ± 0.4 over 5 runs.", []), ("The delay differs: significant at %4$d.2 ± 0.9 ms versus %4$d.6 ± 0.4 ms over 5 runs.", []),
    ("Over 7 runs: %1$d.0, %2$d.0, %3$d.0, %4$d.0, and the loss of another model was 3.5 ± 9.0.", [("count", "FLAGGED")]), ("Results over 4 runs: %1$d.0, %2$d.0, %3$d.0, %4$d.0, average %3$d.5 ± 1.12.", [("mean", "FLAGGED")]),
]


@query("seeds_statistics", " union all ".join(f"select concat('t/', p_partkey, '.md') as file, '{rule}' as rule, '{status}' as status from {{part}} where p_partkey % {len(_RUNS)} = {i}" for i, (_, found) in enumerate(_RUNS) for rule, status in found))
def _seeds_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", (30 + F.col("p_partkey") % 40).alias("a"))
    case = F.col("p_partkey") % len(_RUNS)
    text = F.coalesce(*(F.when(case == i, F.format_string(s, *(F.col("a") + j for j in range(4)))) for i, (s, _) in enumerate(_RUNS)))
    docs = part.select(F.concat(F.lit("t/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("rel"), text.alias("text"))
    return arithmetic.find_seed_rows(split_documents(docs)).select(F.col("rel").alias("file"), "rule", "status")


@query("listed_statistics", """
select l_orderkey, count(*) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sd_population from {lineitem} group by l_orderkey having count(*) > 1""")
def _listed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.stddev_pop(q), 6).alias("sd_population"))
    return out.where("n > 1")


# ---------------------------------------------------------------- citations
LINKED = """
select concat('p/', cast(page_id % 20 as string), '.md') as rel, page_id % 20 as file_ord, concat('See ', url, '. Also arXiv:20', cast(10 + page_id % 12 as string), '.', cast(10000 + page_id % 60 as string), ' and 10.1234/x', cast(page_id % 30 as string), '.') as text from {pages}"""
_FIRST = """
with m as (select page_id % 20 as file_ord, 'url' as kind, regexp_replace(regexp_extract(url, 'https?://[^\\s"''<>{}|\\\\^`\\])]+'), '[.,;:]+$', '') as ident from {pages}
union all select page_id % 20, 'arxiv', concat('20', 10 + page_id % 12, '.', 10000 + page_id % 60) from {pages} union all select page_id % 20, 'doi', concat('10.1234/x', page_id % 30) from {pages})
select kind, ident, concat('p/', min(file_ord), '.md') as rel from m group by kind, ident"""


@query("mention_first_seen", _FIRST.replace("{}|", "\x00|"))
def _mention_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.find_mentions(generated(spark, sf_dir, LINKED))
    return mentions.first_seen(found, ["file_ord", "line", "kind_ord", "pos"]).select("kind", "ident", "rel")


ORACLE_SQL["mention_first_seen"] = ORACLE_SQL["mention_first_seen"].replace("\x00", "{}")


@query("mention_lookup", """
with m as (select distinct 10 + page_id % 12 as y, 10000 + page_id % 60 as n from {pages})
select concat('20', y, '.', n) as ident, case when n % 3 = 0 then 'FLAGGED' when n % 3 = 1 then 'VERIFIED' else 'UNVERIFIABLE' end as status from m""")
def _mention_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.first_seen(mentions.find_mentions(generated(spark, sf_dir, LINKED)), ["file_ord", "line", "kind_ord", "pos"]).where("kind = 'arxiv'")
    tail = F.element_at(F.split("ident", r"\."), -1).cast("int")
    records = found.select("kind", "ident", F.when(tail % 3 == 0, 404).when(tail % 3 == 1, 200).otherwise(403).alias("status_code"))
    return mentions.look_up(found, records).select("ident", "status")


@query("title_similarity", """
with w as (select p_partkey, list_distinct(regexp_extract_all(regexp_replace(lower(p_name), '[^a-z ]', '', 'g'), '[a-z]{3,}')) as a, list_distinct(regexp_extract_all(regexp_replace(lower(concat(p_name, ' ', p_type)), '[^a-z ]', '', 'g'), '[a-z]{3,}')) as b from {part})
select p_partkey, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) as similarity from w""")  # fmt: skip
def _title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mentions.title_similarity(F.col("p_name"), F.concat("p_name", F.lit(" "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(t, 6).alias("similarity"))


# ---------------------------------------------------------------- passages
_NORMAL = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("quote_containment", f"""
with b as (select item_id, {_NORMAL} as q from {{benchmark}}), d as (select doc_id, {_NORMAL} as t from {{documents}})
select item_id as quote_id, doc_id as text_id from b, d where contains(' ' || t || ' ', ' ' || q || ' ')""")
def _quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return passages.contained_quotes(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


_TOKEN_SQL = "unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*'))"


@query("term_absent", f"""
with b as (select distinct {_TOKEN_SQL} as token from {{benchmark}}), d as (select distinct {_TOKEN_SQL} as token from {{conversations}}) select token from b where token not in (select token from d)""")
def _term_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = passages.source_tokens(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ident"), "text"))
    c = passages.source_tokens(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ident"), "text"))
    return passages.absent_terms(b.select("token").distinct(), c)


@query("passage_topk", f"""
with p as (select distinct doc_id as passage, {_TOKEN_SQL} as token from {{documents}}), c as (select distinct item_id as claim, {_TOKEN_SQL} as token from {{benchmark}}), n as (select count(distinct passage) as total from p),
idf as (select token, ln(1 + total / count(*)) as idf from p, n group by token, total), s as (select claim, passage, sum(idf * idf) as score, count(*) as shared from c join p using (token) join idf using (token) group by claim, passage),
r as (select *, row_number() over (partition by claim order by round(score, 9) desc, passage desc) as place from s) select claim, passage, round(score, 6) as score, shared, place from r where place <= 4""")  # fmt: skip
def _passage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = lambda t, i, n: passages.source_tokens(table(spark, sf_dir, t).select(F.col(i).alias("ident"), "text")).select(F.col("ident").alias(n), "token")
    best = passages.best_passages(tok("benchmark", "item_id", "claim"), tok("documents", "doc_id", "passage"))
    return best.select("claim", "passage", F.round("score", 6).alias("score"), "shared", "place")


# ---------------------------------------------------------------- reports
HEADED = """
select source as dir, case when doc_id % 3 = 0 then concat('---\n# Intro\n## Setup\n', text) else concat('# Part ', cast(doc_id % 9 as string), '\n', coalesce(text, '')) end as text from {documents}"""


@query("collected_dirs", """
with d as (select source as dir, case when doc_id % 3 = 0 then '---' || chr(10) || '# Intro' || chr(10) || '## Setup' || chr(10) || text else '# Part ' || (doc_id % 9) || chr(10) || coalesce(text, '') end as text from {documents}),
h as (select dir, coalesce(text like '---%', false) as front, array_to_string(regexp_extract_all(text, '(?m)^#{1,3} (.+)$', 1)[1:6], chr(10)) as shape from d), s as (select dir, shape, count(*) as n from h group by dir, shape),
f as (select dir, count(*) as files, count(*) filter (front) as frontmatter from h group by dir), r as (select dir, cast(sum(case when n > 1 and shape is not null then n else 0 end) as bigint) as repeated from s group by dir)
select dir, files, frontmatter, repeated from f join r using (dir) where files >= 5 and (frontmatter >= 0.8 * files or (files >= 20 and repeated >= 0.2 * files))""")  # fmt: skip
def _collected_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected.collected_directories(generated(spark, sf_dir, HEADED))


FOUND = """
select case o_orderkey % 4 when 0 then 'overclaim' when 1 then 'benchmark' when 2 then 'source' else 'citation' end as check, case o_orderkey % 3 when 0 then 'FLAGGED' when 1 then 'VERIFIED' else 'UNVERIFIABLE' end as status,
concat('f/', cast(o_custkey as string), '.md') as file, cast(o_orderkey % 50 as int) as line, concat('message ', cast(o_orderkey as string)) as message, '' as evidence from {orders}"""


@query("findings_rank", f"""
with f as ({FOUND}) select *, case "check" when 'benchmark' then 11 when 'source' then 15 when 'overclaim' then 50 else 35 end as priority from f where status = 'FLAGGED' order by priority, "check", file, line, message limit 25""")
def _findings_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.top(generated(spark, sf_dir, FOUND), 25)


@query("findings_summary", f"""
with f as ({FOUND}), c as (select unnest(['overclaim', 'benchmark', 'source', 'citation', 'seeds']) as check)
select c.check, count(*) filter (status = 'VERIFIED') as verified, count(*) filter (status = 'FLAGGED') as flagged, count(*) filter (status = 'UNVERIFIABLE') as unverifiable from c left join f on c.check = f.check group by c.check""")
def _findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(generated(spark, sf_dir, FOUND), ["overclaim", "benchmark", "source", "citation", "seeds"])


@query("per_check_limit", f"""
with f as ({FOUND}), r as (select *, row_number() over (partition by "check" order by case status when 'FLAGGED' then 0 when 'UNVERIFIABLE' then 1 else 2 end, file, line, message) as place, count(*) over (partition by "check") as total from f)
select "check", status, file, line, message, place, total, greatest(total - 200, 0) as trimmed from r where place <= 200""")
def _per_check_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.listed(generated(spark, sf_dir, FOUND), 200).drop("evidence")


@query("overall_totals", f"""
with f as ({FOUND}) select count(*) filter (status = 'VERIFIED') as verified, count(*) filter (status = 'FLAGGED') as flagged, count(*) filter (status = 'UNVERIFIABLE') as unverifiable from f""")
def _overall_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.totals(generated(spark, sf_dir, FOUND))


# ---------------------------------------------------------------- more of the value index
SHARES = "select o_orderkey, cast(case when o_orderkey % 3 = 0 then 1 else 0 end as int) as is_rush, cast(o_orderkey % 11 as double) / 10 as score from {orders}"


@query("binary_share", f"""
with t as ({SHARES}), x as (select cast(is_rush as double) as v from t) select 'count' as what, cast(count(*) as double) as value from x union all select 'mean', round(avg(v), 6) from x union all select 'median', median(v) from x union all select 'min', min(v) from x
union all select 'max', max(v) from x union all select 'sum', sum(v) from x union all select 'std', round(stddev_samp(v), 6) from x union all select 'share', round(100 * avg(v), 6) from x union all select 'count true', sum(v) from x""")  # fmt: skip
def _binary_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = values.unpivot(generated(spark, sf_dir, SHARES).select("is_rush"), "shares")
    return values.numeric_aggregates(cells).select("what", F.round("value", 6).alias("value"))


@query("row_counts", "select 'part' as file, cast(count(*) as double) as value from {part} union all select 'nation', cast(count(*) as double) from {nation}")
def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [values.index_table(table(spark, sf_dir, t), t) for t in ("part", "nation")]
    return made[0].unionByName(made[1]).where(F.col("where") == "row count").select("file", "value")


@query("json_values", """
with s as (select concat('runs/', s_suppkey, '.json') as file, cast(s_suppkey as double) as k from {supplier}) select file, 'final' as "where", k as value from s
union all select file, 'pooled.names length', 2.0 from s union all select file, concat('pooled.runs[', i, ']'), k + case i when 0 then 0 when 1 then 2 else 7 end from s, (select unnest([0, 1, 2]) as i) union all select file, concat('pooled.runs ', w), round(case w when 'count' then 3 when 'mean' then k + 3 when 'median' then k + 2 when 'min' then k when 'max' then k + 7 when 'sum' then 3 * k + 9 else sqrt(13) end, 6)
from s, (select unnest(['count', 'mean', 'median', 'min', 'max', 'sum', 'std']) as w)""")  # fmt: skip
def _json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_index.index_json(json_index.walk_json(_lists(spark, sf_dir))).select("file", "where", F.round("value", 6).alias("value"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.format_string('{"final": %d, "pooled": {"runs": [%d, %d, %d], "names": ["x", "y"]}}', k, k, k + 2, k + 7)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("runs/"), k.cast("string"), F.lit(".json")).alias("file"), text.alias("text"))


# ---------------------------------------------------------------- citations against records
@query("citation_verdicts", """
select concat(1000 + p_partkey // 90000, '.', 10000 + p_partkey % 90000) as ident, case p_partkey % 6 when 0 then 'FLAGGED' when 1 then 'VERIFIED' when 2 then 'FLAGGED' when 3 then 'FLAGGED' else 'UNVERIFIABLE' end as status,
case p_partkey % 6 when 0 then 'not found' when 1 then 'matches bib authors/title' when 2 then 'bib entry does not match the record' when 3 then 'bib entry does not match the record' else 'could not be checked' end as said,
case p_partkey % 6 when 2 then 'authors differ: record Ann Doe' when 3 then 'title differs: record Quite another thing' else '' end as evidence, cast(2 as int) as line from {part}""")  # fmt: skip
def _citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries for each identifier, the last of which stands for it; authors, titles and answers by the key."""
    part = table(spark, sf_dir, "part")
    k, ident = F.col("p_partkey"), F.expr("concat(1000 + p_partkey div 90000, '.', 10000 + p_partkey % 90000)")
    fields = lambda author: F.create_map(F.lit("eprint"), ident, F.lit("title"), F.lit("A Study of Many Things"), F.lit("author"), F.lit(author))
    entry = lambda line, author: part.select(F.concat(F.lit("b/"), k.cast("string"), F.lit(".bib")).alias("rel"), F.lit("a").alias("ord"), F.concat(F.lit(f"k{line}_"), k.cast("string")).alias("key"), fields(author).alias("fields"), F.lit(line).alias("line"), F.lit(None).cast("string").alias("unread"))
    bib = entry(1, "Nobody, At All").unionByName(entry(2, "Doe, Jane and Roe, Max"))
    authors = F.when(k % 6 == 2, F.array(F.lit("Ann Doe"))).otherwise(F.array(F.lit("Jane Doe"), F.lit("Max Roe")))
    title = F.when(k % 6 == 3, "Quite another thing").otherwise("A study of many things")
    records = part.where("p_partkey % 6 <> 5").select(F.lit("arxiv").alias("kind"), ident.alias("ident"), F.when(k % 6 == 0, 404).when(k % 6 == 4, 403).otherwise(200).alias("status_code"), title.alias("title"), authors.alias("authors"))
    docs = spark.createDataFrame([], "rel string, ord string, text string")
    found = citation.check_citations(docs, bib, records)
    return found.select(F.regexp_extract("message", "arXiv:([0-9.]+):", 1).alias("ident"), "status", F.regexp_extract("message", ": (.*)$", 1).alias("said"), "evidence", "line")


# ---------------------------------------------------------------- support
_CITING = [
    ("Smith et al. \\\\cite{k%s} show that it holds.", "UNVERIFIABLE", "nothing checkable"), ("Jones et al. \\\\cite{k%s} show that it holds.", "FLAGGED", "names Jones"), ("See the 2010 paper \\\\cite{k%s} now.", "FLAGGED", "to 2010"),
    ("They show that ZebraNet works \\\\cite{k%s}.", "FLAGGED", "ZebraNet"), ("They never mention conformal prediction \\\\cite{k%s}.", "FLAGGED", "its text does"), ("Its accuracy was 91.5 in the paper \\\\cite{k%s}.", "FLAGGED", "91.5"), ("They show that TurboNet works \\\\cite{missing}.", "UNVERIFIABLE", "no arXiv id"),
]


def _support_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One citing sentence for each supplier, a bibliography whose first entry of a key wins, and the sources."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    sentence = F.get(F.array(*(F.lit(s.replace("\\\\", "\\")) for s, _, _ in _CITING)), (F.col("k") % len(_CITING)).cast("int"))
    docs = k.select(F.concat(F.lit("p/"), F.col("k").cast("string"), F.lit(".tex")).alias("rel"), F.concat(F.lit("A sentence before it. "), F.replace(sentence, F.lit("%s"), F.col("k").cast("string"))).alias("text"))
    key, ident = F.concat(F.lit("k"), F.col("k").cast("string")), F.concat(F.lit("arxiv:2001."), F.lpad(F.col("k").cast("string"), 5, "0"))
    bib = k.select(key.alias("key"), ident.alias("ident"), F.lit("1").alias("ord")).unionByName(k.select(key.alias("key"), F.lit("arxiv:9901.00001").alias("ident"), F.lit("2").alias("ord")))
    body = "Conformal prediction is a method that holds. Conformal prediction again. TurboNet works and the results follow. " * 3
    sources = k.select(ident.alias("ident"), F.lit("A title").alias("title"), F.array(F.lit("Ann Smith")).alias("authors"), F.lit(2020).alias("year"), F.lit(True).alias("trusted"), F.lit(body).alias("body"), F.lit("").alias("refs"))
    return docs, bib, sources


@query("support_verdicts", "select concat('p/', s_suppkey, '.tex') as file, cast(1 as int) as line, case s_suppkey % 7 " + " ".join(f"when {i} then '{s}'" for i, (_, s, _) in enumerate(_CITING)) + " end as status, true as reason_given from {supplier}")
def _support_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = support.check_support(*_support_tables(spark, sf_dir), most_sources=1_000_000)
    case = F.regexp_extract("file", r"p/(\d+)\.tex", 1).cast("int") % len(_CITING)
    wanted = F.get(F.array(*(F.lit(w) for _, _, w in _CITING)), case)
    return found.select("file", "line", "status", F.contains("message", wanted).alias("reason_given"))


#: Sentences that cite two sources: one has the term, none has it, one is not trusted, a figure of the second, a word that the document uses itself, one beyond the cap.
_SEVERAL = [
    ("They show that QuokkaNet works \\cite{a%s,b%s}.", "UNVERIFIABLE", "nothing checkable"), ("They show that ZebraNet works \\cite{a%s,b%s}.", "FLAGGED", "ZebraNet"), ("They show that ZebraNet works \\cite{a%s,c%s}.", "UNVERIFIABLE", "could not be read"),
    ("Their accuracy was 91.5 in the papers \\cite{a%s,b%s}.", "UNVERIFIABLE", "nothing checkable"), ("They show that ZebraNet works \\cite{a%s,b%s}. We like ZebraNet a lot.", "UNVERIFIABLE", "nothing checkable"), ("They show that ZebraNet works \\cite{a%s,z%s}.", "UNVERIFIABLE", "beyond the first"),
]


@query("support_several_sources", "select concat('q/', lpad(cast(s_suppkey as varchar), 9, '0'), '.tex') as file, cast(1 as int) as line, case s_suppkey % 6 " + " ".join(f"when {i} then '{s}'" for i, (_, s, _) in enumerate(_SEVERAL)) + " end as status, true as reason_given from {supplier}")
def _support_several_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cited source counts; those first cited in documents that come last are beyond a cap of all but them."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name, case = F.lpad(F.col("k").cast("string"), 9, "0"), (F.col("k") % len(_SEVERAL)).cast("int")
    sentence = F.get(F.array(*(F.lit(s) for s, _, _ in _SEVERAL)), case)
    docs = k.select(F.concat(F.lit("q/"), name, F.lit(".tex")).alias("rel"), F.replace(sentence, F.lit("%s"), name).alias("text"))
    # One more document, the last, cites what is beyond the cap first; the others of that kind come after it.
    ident = lambda kind: F.concat(F.lit(f"arxiv:{kind}."), name)
    made = {"a": ("Many things are said here.", True), "b": ("QuokkaNet reached 91.5 there.", True), "c": ("Many things are said here.", False)}
    bib = [k.select(F.concat(F.lit(x), name).alias("key"), ident(x).alias("ident"), F.lit("1").alias("ord")) for x in (*made, "z")]
    sources = [k.select(ident(x).alias("ident"), F.lit("T").alias("title"), F.array(F.lit("Ann Smith")).alias("authors"), F.lit(2020).alias("year"), F.lit(ok).alias("trusted"), F.lit(body).alias("body"), F.lit("").alias("refs")) for x, (body, ok) in made.items()]
    late = docs.where(case == 5).withColumn("rel", F.concat(F.lit("z"), "rel"))
    docs = docs.where(case != 5).unionByName(late)
    most = docs.where("rel like 'q/%'").count() * 2
    found = support.check_support(docs, bib[0].unionByName(bib[1]).unionByName(bib[2]).unionByName(bib[3]), sources[0].unionByName(sources[1]).unionByName(sources[2]), most_sources=most)
    wanted = F.get(F.array(*(F.lit(w) for _, _, w in _SEVERAL)), (F.regexp_extract("file", r"q/(\d+)\.tex", 1).cast("long") % len(_SEVERAL)).cast("int"))
    return found.select(F.regexp_replace("file", "^zq", "q").alias("file"), "line", "status", F.contains("message", wanted).alias("reason_given"))


@query("support_bibliography_authors", "select concat('v/', s_suppkey, '.tex') as file, case s_suppkey % 4 when 1 then 'FLAGGED' when 3 then 'FLAGGED' else 'UNVERIFIABLE' end as status from {supplier}")
def _support_bibliography_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors as on the record; others; a surname alone, which no source must hold; a name beside a citation that is no author's. Textual citations print their names themselves."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    key, ident, case = F.concat(F.lit("k"), F.col("k").cast("string")), F.concat(F.lit("arxiv:2002."), F.lpad(F.col("k").cast("string"), 9, "0")), F.col("k") % 4
    sentence = F.when(case == 2, "They show that the Hoffmánn bound holds \\cite{%s}.").when(case == 3, "Smith et al. \\cite{%s} show that it holds.").otherwise("Smith and Poe \\citet{%s} show that it holds.")
    docs = k.select(F.concat(F.lit("v/"), F.col("k").cast("string"), F.lit(".tex")).alias("rel"), F.replace(sentence, F.lit("%s"), key).alias("text"))
    bib = k.select(key.alias("key"), ident.alias("ident"), F.lit("1").alias("ord"), F.when(case == 1, F.array(F.lit("doe"))).otherwise(F.array(F.lit("hoffmann"))).alias("authors"))
    sources = k.select(ident.alias("ident"), F.lit("T").alias("title"), F.array(F.lit("Ann Hoffmann"), F.lit("Max Roe")).alias("authors"), F.lit(2020).alias("year"), F.lit(True).alias("trusted"), F.lit("It is a bound and it holds.").alias("body"), F.lit("").alias("refs"))
    return support.check_support(docs, bib, sources, most_sources=1_000_000).select("file", "status")


@query("citing_context", "select concat('p/', s_suppkey, '.tex') as rel, 'A sentence before it.' as context, case when s_suppkey % 7 = 6 then null else concat('arxiv:2001.', lpad(cast(s_suppkey as varchar), cast(greatest(5, length(cast(s_suppkey as varchar))) as int), '0')) end as ident from {supplier}")
def _citing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bib, _ = _support_tables(spark, sf_dir)
    return support.find_pairs(docs, bib).select("rel", "context", F.get("idents", F.lit(0)).alias("ident"))


_REPLIES = [("SUPPORTED", "the recall on images of cats reaches 91.2 percent in every run", "NONE", "SUPPORTED"), ("CONTRADICTED", "the recall on images of cats reaches 91.2 percent in every run", "", "CONTRADICTED"), ("SUPPORTED", "no passage says these six words at all", "NONE", "UNCLEAR"), ("SUPPORTED", "the recall on images of cats reaches 91.2 percent in every run", "NARROWS", "UNCLEAR"), ("", "", "", "UNCLEAR")]


@query("model_verdicts", "select n_nationkey, case n_nationkey % 5 " + " ".join(f"when {i} then '{v}'" for i, (*_, v) in enumerate(_REPLIES)) + " end as verdict, cast(2 as int) as n_shown from {nation}")
def _model_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies are kept by the key of what was shown, so they are made from a first pass without any."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("Many other words stand here first. Then the recall on images of cats reaches 91.2 percent in every run of "), F.lower("n_name"), F.lit(". Other words follow here now."))
    claims = table(spark, sf_dir, "nation").select(k, F.concat(F.lit("The recall on cats images is 91.2% for "), F.lower("n_name"), F.lit(".")).alias("claim"), F.lit("").alias("context"), text.alias("text"), F.lit("An abstract.").alias("abstract"))
    asked = judge.judge_claims(claims, spark.createDataFrame([], "key string, first string, second string")).select("n_nationkey", "key")
    pick = lambda i: F.get(F.array(*(F.lit(r[i]) for r in _REPLIES)), (k % len(_REPLIES)).cast("int"))
    replies = asked.select("key", F.to_json(F.struct(pick(0).alias("verdict"), pick(1).alias("quote"), F.lit("E2").alias("excerpt"))).alias("first"), F.to_json(F.struct(pick(2).alias("finding"))).alias("second"))
    return judge.judge_claims(claims, replies).select("n_nationkey", "verdict", F.size("shown").alias("n_shown"))


# ---------------------------------------------------------------- similarity below one
OVERLAPPING = """
select concat(f, '/', cast(c_custkey as string), '.md') as rel, c_custkey, concat('Group ', w, 'qa ', w, 'zo ', w, 'vu ', case when f = 'b' and c_custkey % 3 = 0 then concat(w, 'xy ') else '' end, 'counted ', cast(1000 + c_custkey % 700 as string), ' orders.') as text
from (select c_custkey, """ + _word("c_custkey") + """ as w, f from {customer} cross join (select 'a' as f union all select 'b') x) y"""


@query("consistency_overlap", "select c_custkey, round(case when c_custkey % 3 = 0 then 6.0 / 7 else 1 end, 6) as similarity from {customer}")
def _consistency_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = consistency.similar_claims(extract_claims(split_documents(generated(spark, sf_dir, OVERLAPPING))))
    return pairs.select(F.regexp_extract("a_rel", r"(\d+)\.md", 1).cast("long").alias("c_custkey"), F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- kept answers and the budget of calls
ATTEMPTS = """
select concat('https://x.org/', cast(o_custkey as string)) as key, cast(o_orderkey % 3 as string) as version, cast(o_orderdate as timestamp) as taken,
cast(case o_orderkey % 9 when 0 then 0 when 1 then 403 when 2 then 503 when 3 then 404 when 4 then 429 else 200 end as int) as status_code, concat('body ', cast(o_orderkey as string)) as body from {orders}"""
_KEPT = f"""
with log as ({ATTEMPTS}), good as (select * from log where status_code > 0 and status_code < 500 and status_code not in ({", ".join(map(str, citation.BLOCKED))})),
kept as (select *, row_number() over (partition by key, version order by taken desc, status_code desc, body desc) as place from good), now as (select max(taken) - interval 30 day as now from log)"""


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log in three batches, the last of them twice."""
    log = generated(spark, sf_dir, ATTEMPTS)
    batch = lambda i: log.where(F.pmod(F.xxhash64("body"), F.lit(3)) == i)
    kept = answers.upsert(None, batch(0))
    for i in (1, 2, 2):
        kept = answers.upsert(kept, batch(i))
    return log, kept


@query("kept_answers", _KEPT + " select key, version, taken, status_code, body from kept where place = 1")
def _kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir)[1]


@query("answers_to_ask", _KEPT + """
select distinct key from log where key not in (select key from kept, now where place = 1 and version = '1' and taken > now - interval 200 day and taken <= now)""")
def _answers_to_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, kept = _kept(spark, sf_dir)
    now = log.agg(F.max("taken").alias("taken")).first().taken
    return answers.to_ask(log.select("key"), kept, "1", F.lit(now) - F.make_interval(days=F.lit(30)), days=200)


ASKING = "select concat('k', cast(o_orderkey % 997 * 31 + o_orderkey as string)) as key, o_orderkey as ord, 1 + o_orderkey % 2 as cost from {orders}"


@query("judge_budget", f"""
with c as ({ASKING}), f as (select *, case when ord % 5 = 0 then 0 else cost end as paid from (select *, row_number() over (partition by key order by ord) as place from c) where place = 1),
r as (select *, coalesce(sum(paid) over (order by ord, key rows between unbounded preceding and 1 preceding), 0) as before from f)
select c.key, c.ord, case when r.ord % 5 = 0 then 'cached' when r.before + 2 <= (select count(*) // 3 from c) then 'asked' else 'beyond' end as state, cast(r.before as bigint) as before from c join r using (key)""")  # fmt: skip
def _judge_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = generated(spark, sf_dir, ASKING)
    return budget.allocate(claims, claims.where("ord % 5 = 0").select("key"), claims.count() // 3).select("key", "ord", "state", "before")


CALLS = "select case when o_orderkey % 4 = 0 then 'small' else 'large' end as model, case when o_orderkey % 7 = 0 then null else 100 + o_orderkey % 50 end as input_tokens, o_orderkey % 20 as output_tokens from {orders}"


@query("judge_usage", f"select model, count(*) as calls, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from ({CALLS}) group by model")
def _judge_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.usage(generated(spark, sf_dir, CALLS))
