"""The registered query of each operator of this subpackage, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import find_contamination
from .embed_dedup import embedding_dedup
from .langid import identify_languages
from .license_scan import learn_licences, scan_licences
from .minhash_dedup import minhash_dedup
from .pii import find_pii
from .prefix_trie import prefix_trie
from .quality import learn_quality, score_quality
from .secret_scan import scan_secrets
from .sp_sampling import sample_segmentations
from .token_store import store_and_read
from .warc import archive_pages
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark, _table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return scan_licences(docs, learn_licences(docs))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, _table(spark, sf_dir, "labels")))


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sample_segmentations(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2)
    return made.select("doc_id", "sample", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion", "decoded_ok")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), top=16)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"), least=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"), family=20, modulus=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_embedding_dedup, op3_token_store, op4_license_scan, op5_secret_scan, op6_decontamination, op7_quality, op8_sentencepiece_sampling, op9_minhash_dedup, op10_pii,
              op11_whitening, op12_warc, op13_prefix_trie)
}

_WARC = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
g as (select *, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes::bigint as payload_bytes, sha1(html) as payload_digest,
    case when payload_bytes >= 1000 and page_id is distinct from last then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id is distinct from last then last end as refers_to
from g
"""

#: CRC-32 of the decimal digits, bit by bit; prefixes as lists; every node adds to each of its ancestors.
_TRIE = r"""
with t as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, coalesce(role, '') as r, coalesce(text, '') as x
    from conversations where conv_id is not null),
s as (select c, count(*) as n, c - c % 20 as base from t group by c),
crc as (
    select c, n, base, (4294967295 - list_reduce(
        list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)), 4294967295::bigint)) % 4 as h
    from s),
plan as (select crc.c, crc.n, crc.h, crc.base, least(crc.h, coalesce(b.n, 0)) as m from crc left join s b on b.c = crc.base),
turns as (
    select p.c, p.m + t.pos - p.h as pos, t.r, t.x from t join plan p on t.c = p.c where t.pos > p.h
    union all
    select p.c, t.pos, t.r, t.x from plan p join t on t.c = p.base and t.pos <= p.m),
convs as (select p.c, coalesce(list({'r': r, 'x': x} order by pos) filter (where pos is not null), []) as path from plan p left join turns using (c) group by p.c),
steps as (select c, len(path) as size, unnest(range(0, len(path) + 1)) as depth, path from convs),
nodes as (
    select depth, path[1:depth] as prefix, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where size = depth), '')) as ends_sha256
    from steps group by all),
kids as (select depth - 1 as depth, prefix[1:depth - 1] as prefix, count(*) as n from nodes where depth > 0 group by all),
full_nodes as (
    select n.*, coalesce(k.n, 0) as n_children, case when n.depth = 0 then 0 else (n.n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].x, '[^\x20\x09-\x0D]+')) end as saved
    from nodes n left join kids k using (depth, prefix)),
above as (select prefix, depth, unnest(range(0, depth + 1)) as up, saved, n_children from full_nodes),
sums as (select up as depth, prefix[1:up] as prefix, sum(saved)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from above group by all)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
from full_nodes f join sums s using (depth, prefix) left join nodes p on p.depth = f.depth - 1 and p.prefix = f.prefix[1:f.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {"op12_warc": _WARC, "op13_prefix_trie": _TRIE}
