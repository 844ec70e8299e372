"""Whitening, WARC archives and the prefix trie against plain code, and on odd rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from proofmill.llm import prefix_trie, warc, whitening
from proofmill.llm import queries as llm_queries
from proofmill.llm.common import Scratch


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = llm_queries.QUERIES[name](spark, sf_dir)
    rel = con.sql(llm_queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(r[rel.columns.index(c)] for c in df.columns) for r in rel.fetchall()]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


# ---------------------------------------------------------------- 11 whitening
def plain_whitening(rows, top=16):
    """Integers, then NumPy's symmetric eigenvectors, in place of rotations."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:top]
    out = {}
    for i, v in x.items():
        diff = [n * a - s for a, s in zip(v, sums, strict=True)]
        out[i] = n, sum(d * d for d in diff), (np.array(diff) / n) @ vectors[:, order] / np.sqrt(values[order])
    return out, values[order] / values.sum()


def spread(r, n, d):
    """Vectors whose deviations differ from one dimension to the next, so that components are well apart."""
    return r.normal(size=(n, d)) @ np.diag(np.linspace(1, 6, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0]


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_equals_plain_eigenvectors(spark, parts):
    r = np.random.default_rng(5)
    x = spread(r, 300, 20)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)] + [(1000 + i, x[0].tolist(), 2, "y") for i in range(80)] + [(5, x[5].tolist(), 3, "z"), (5, x[6].tolist(), 3, "z")]
    odd = [(i, v, 0, None) for i, v in enumerate([None, [1.0, None] + [0.0] * 18, [float("nan")] * 20, [float("inf")] + [0.0] * 19, []], 2000)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int, x string").repartition(parts)
    got = whitening.whiten(df).collect()
    assert len(got) == len(rows) * 16
    want, explained = plain_whitening([(i, v) for i, v, *_ in rows[:-1]])
    sign = {}
    for o in got:
        if o.vec_id == 5:
            continue
        n, deviation, w = want[o.vec_id]
        k = o.component - 1
        s = sign.setdefault(k, 1 if w[k] * o.whitened > 0 else -1)
        assert (o.n, o.deviation) == (n, deviation) and o.whitened == pytest.approx(s * w[k], abs=1e-7) and o.explained == pytest.approx(explained[k], rel=1e-8) and o.identity_error < 1e-9
    assert sum(o.vec_id == 5 for o in got) == 48


def test_whitening_without_variance(spark):
    """Equal rows, one row, dependent and constant dimensions, several lengths, an empty table, entries of any size."""
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert {(o.vec_id, o.component, o.n, o.deviation, o.whitened, o.explained, o.identity_error) for o in one} == {(i, k, 1, 0, None, 0.0, None) for i in (1, 2, None) for k in (1, 2)}
    r = random.Random(2)
    rows = [(i, [a, a, 7.0]) for i, a in enumerate(r.uniform(-1, 1) for _ in range(50))] + [(100 + i, [r.uniform(-1, 1)]) for i in range(9)] + [(200, [])]
    got = whitening.whiten(make(rows)).collect()
    assert len(got) == 150 + 9
    for o in got:
        assert (o.whitened is None) == (o.vec_id < 100 and o.component > 1) and o.identity_error < 1e-9 and o.explained == pytest.approx(float(o.component == 1))
    assert whitening.whiten(make([])).count() == 0
    huge = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 0.5]), (3, [3.0, 1.0])])).collect()
    near = (3 * 192 - 192) ** 2 + (3 * 64 - 96) ** 2  # the two bounds cancel each other
    assert {o.vec_id: o.deviation for o in huge} == {1: None, 2: None, 3: near} and all(math.isfinite(o.whitened) for o in huge if o.whitened is not None)
    big = whitening.whiten(make([(i, [c * 1e6]) for i, c in enumerate((1.0, 2.0, 4.0))])).collect()
    assert [o.deviation for o in sorted(big)] == [(3 * 64 * 10**6 * c - 7 * 64 * 10**6) ** 2 for c in (1, 2, 4)]


@pytest.mark.parametrize(("rows", "columns"), [(9, 9), (30, 7), (3, 8), (1, 1), (0, 4)])
def test_jacobi(rows, columns):
    a = np.random.default_rng(rows).normal(size=(rows, columns)) * 10.0 ** -np.arange(columns)
    lengths, v = whitening.jacobi(a)
    assert np.allclose(v.T @ v, np.eye(columns), atol=1e-13)
    want = np.zeros(columns)
    want[: min(rows, columns)] = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(lengths, want, rtol=1e-9, atol=1e-15)
    gram = (a @ v).T @ (a @ v)
    assert np.allclose(gram, np.diag(lengths**2), atol=1e-12)


# ---------------------------------------------------------------- 12 WARC
PAGES = "page_id long, url string, html string, revisit string, key string, size int"


def test_pages_round_trip(spark):
    long = "<p>ünïcödé \r\n\r\n WARC/1.1 \0 </p>" * 9000
    r = random.Random(4)
    noise = "".join(chr(r.randrange(32, 0x2000)) for _ in range(90_000))
    html = [None, "", "x", "x", "a" * 999, "a" * 999, "a" * 1000, "a" * 1000, "a" * 1000, long, noise, long, "é" * 500, "é" * 500, "é" * 499, "é" * 499, "\r\n\r\n", "漢" * 400]
    rows = [(i, f"http://h/{i} ü\r\nX: y", t, "clash", "k", 1) for i, t in enumerate(html)] + [(None, None, "a" * 1000, None, None, None), (None, None, "b" * 2000, None, None, None), (8, "u", "a" * 1000, None, None, None), (3, "u", None, None, None, None)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.archive_pages(df).collect()
    last = {}
    for i, _, t, *_ in rows:
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    want = []
    for i, _, t, *_ in rows:
        raw = (t or "").encode()
        again = len(raw) >= 1000 and (-1 if i is None else i) != last[t]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[t] if again else None))
    key = lambda x: repr(x)
    assert sorted(((o.page_id, o.payload_bytes, o.payload_digest, o.record_type, o.refers_to) for o in got), key=key) == sorted(want, key=key)
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_plain_gzip_members(spark, tmp_path):
    """Each record is a member that gzip inflates, framed by its own length; archives roll; payloads come back whole."""
    rows = [(i, f"u{i}", "y%d " % i * 5000, None, None, None) for i in range(30)]
    df = warc.mark_revisits(spark.createDataFrame(rows, PAGES).coalesce(1), Scratch(spark, "t"))
    written = Scratch(spark, "t").write(warc.write_warc(df, str(tmp_path / "out"), roll=1000), "w")
    names = [r.archive for r in written.collect()]
    assert len(names) > 3 and sum(r.bytes for r in written.collect()) == sum(p.stat().st_size for p in (tmp_path / "out").iterdir())
    listed = warc.read_warc(warc.list_warc(spark, str(tmp_path / "out")), with_payload=True).where("page_id is not null").collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in listed} == {(i, u, t) for i, u, t, *_ in rows} and all(r.error is None for r in listed)
    raw = (tmp_path / "out" / names[0].rsplit("/", 1)[1]).read_bytes()
    at = [r["offset"] for r in warc.read_archive(io.BytesIO(raw))]
    for a, b in zip(at, [*at[1:], len(raw)], strict=True):
        text = gzip.decompress(raw[a:b])
        head, rest = text.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4 and rest.endswith(b"\r\n\r\n")


def test_damage_is_reported():
    good = [warc.page_record(i, "u", b"%d" % i * 70_000, False, None) for i in range(3)]
    read = lambda raw: [(r["offset"], r.get("page_id"), r["error"]) for r in warc.read_archive(io.BytesIO(raw))]
    assert [x[1:] for x in read(b"".join(good))] == [(0, None), (1, None), (2, None)]
    lie = lambda old, new: zlib_member(gzip.decompress(good[1]).replace(old, new))

    def zlib_member(raw):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()

    for bad, error in [
        (lie(b"1" * 70_000, b"1" * 69_999 + b"2"), "block digest differs"), (lie(b"1" * 70_000, b"1" * 69_000), "short of"), (lie(b"1" * 70_000, b"1" * 70_001), "besides"), (lie(b"WARC/1.1", b"HTTP/1.1"), "version"),
        (zlib_member(b"WARC/1.1\r\n" + b"x" * 100), "no end of header"), (lie(b"Content-Length: 70", b"Content-Length: x"), "no number"), (lie(b"sha1:", b"sha1:1"), "base 32"),
    ]:
        found = read(good[0] + bad + good[2])
        assert [x[1] for x in found] == [0, None, 2] and error in found[1][2], (error, found)
    assert [x[2] for x in read(good[0] + good[1][:-30])] == [None, "cut off within a member"]
    assert read(good[0] + b"junk" * 20 + good[2])[1][2].startswith("not gzip") and read(b"") == []


def test_other_writers_records():
    """Header names in any case, folded lines, hex digests, records without HTTP framing."""
    body = b"plain\r\n\r\nbody"
    head = f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Target-URI:\r\n http://h/\r\nContent-Type: text/plain\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest().upper()}\r\nCONTENT-LENGTH: {len(body)}\r\n\r\n".encode()
    (r,) = warc.read_archive(io.BytesIO(gzip.compress(head + body + b"\r\n\r\n")), with_payload=True)
    assert (r["record_type"], r["url"].strip(), r["payload"], r["error"]) == ("resource", "http://h/", body, None)


# ---------------------------------------------------------------- 13 prefix trie
def plain_trie(rows):
    """Nodes as tuples of turns in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(who) - 1) * words(p)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(w), len(p), min(members[p[:-1]]) if p else -99, len(w), children[p], leaves[p], saved[p], sha(p)) for p, w in members.items())


def got_trie(df, **k):
    return sorted((o.conv_id, o.depth, -99 if o.parent_conv_id is None else o.parent_conv_id, o.n_convs, o.n_children, o.n_leaves, o.saved_tokens, o.ends_sha256) for o in prefix_trie.prefix_trie(df, **k).collect())


TURNS = "conv_id long, turn long, role string, text string, pos int, node string, n int"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_code(spark, monkeypatch, seed):
    """Copies, shared beginnings of many turns, one very long conversation and its copy, odd rows."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    r = random.Random(seed)
    rows = []
    for c in range(-45, 120):
        kind = r.random()
        if kind < 0.3:
            path = [("user", f"w{i} x  y")  for i in range(6)]
        elif kind < 0.5:
            path = [("user", "hello there")] * r.randint(0, 12)
        else:
            path = [(r.choice(["user", None, "a:b"]), r.choice(["", None, "p q", " ", "b c\td"])) for _ in range(r.randint(1, 9))]
        rows += [(c, None if i == 0 and r.random() < 0.5 else i, *t) for i, t in enumerate(path)]
    rows += [(c, i, "u", f"t{i % 7}") for c in (400, 401, 403) for i in range(70 + (c == 403))]
    rows += [(None, 1, "u", "no conversation"), (500, 3, "u", "a"), (500, 3, "u", "a")]
    df = spark.createDataFrame([(*x, 1, "n", 2) for x in rows], TURNS).repartition(7)
    assert got_trie(df) == plain_trie(rows)


def test_trie_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got_trie(make([])) == []
    for rows in ([(20, 1, "u", "a b")], [(21, 1, "u", "a")], [(7, i, "u", "a") for i in range(9)], [(20, 1, "u", "a"), (40, 1, "u", "a")], [(c, 1, None, None) for c in range(1, 9)]):
        assert got_trie(make(rows)) == plain_trie(rows)


def test_positions_over_many_tasks(spark):
    """A conversation that holds most rows is numbered over all the tasks that it lies in."""
    rows = [(5, i // 3, bytes([i % 251]), 1) for i in range(4000)] + [(c, 1, b"x", 1) for c in (1, 2, 9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = prefix_trie.positions(spark.createDataFrame(rows, "c long, turn long, key binary, words long").repartition(8), Scratch(spark, "t")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [key for _, _, key in sorted((t, key, key) for c, t, key, _ in rows if c == 5)]
    assert [bytes(o.key) for o in sorted((o for o in made if o.c == 5), key=lambda o: o.pos)] == want
    assert sorted(o.pos for o in made if o.c == 5) == list(range(1, 4001)) and sorted((o.c, o.pos) for o in made if o.c != 5) == [(1, 1), (2, 1), (9, 1)]
