"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts are lower-cased (A-Z only) and cut into words at ASCII white space; a document's set is its
distinct k-word shingles, or its whole word sequence if it has fewer than k words. Documents with
equal sets are one class first, so exact copies never meet each other again. One representative of each
class is signed with MinHash values and banded. Banded candidates are compared batch by batch of their
signatures: after n compared values with m matches the posterior probability (uniform prior) that the
similarity reaches the threshold is P(Binomial(n + 1, threshold) <= m); below the chosen miss
probability the pair is dropped. Survivors are verified on the full shingle sets of both texts.

No bucket is expanded into all its pairs. First every member meets the likeliest of its buckets' smallest ids, then, where
a bucket still holds several components, that of other centres. That only saves work: every bucket that remains open after it, those of two members
too, is compared in blocks, members of the bucket's main component only against the others, and each pair only in the first bucket that holds both. Blocks see signatures first;
texts go only to the buckets where these leave a document a pair. Pairs of chunks, and the members that meet one centre, are dealt over tasks;
keys of many rows (classes, marks, centres) are joined by broadcast of their bounded number.

Defined results: null or blank texts have an empty set and link with nothing; rows that repeat a doc_id
count as one document for links, each row is returned; a null doc_id takes its class's component, or null. A similarity of exactly
`percent` links; of equal candidates the smaller id is taken. Texts of any length are read whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, connected_components, is_empty, join_unique, with_hot
from .hashing import mixed, shingles, word_hashes

#: Members that meet one centre in one place.
SPLIT = 2048


def words_of(text: str | None) -> list[bytes]:
    """Words as bytes; bytes.lower() changes A-Z only and bytes.split() cuts at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The exact set that links are confirmed on."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.a = r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.b = r.integers(0, 1 << 32, n, dtype=np.uint32)
        self.c = r.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        out, high = np.full(len(self.a), 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(high), 1024):
                part = self.a[:, None] * high[None, at : at + 1024]
                part += self.b[:, None]
                np.minimum(out, part.min(axis=1), out=out)
        return out

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            rows = (mixed(values.astype(np.uint64).reshape(self.bands, self.rows)) * self.c).sum(axis=1, dtype=np.uint64)
            return mixed(rows + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, fewest matches among the first n values that keep a pair) for each batch."""
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _survive(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the row pairs that no batch prunes, and how many of their values are equal."""
    live, matched, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, least in steps:
        matched[live] += (x[live, at:n] == y[live, at:n]).sum(axis=1)
        live, at = live[matched[live] >= least], n
    return live, matched[live]


class Confirmer:
    """Links of one document to others on the full sets; hashed sets turn most of the unlinked away first."""

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def read(self, text: str | None) -> dict:
        return {"hashed": np.unique(shingles(word_hashes([(text or "").encode("utf-8", "surrogatepass")])[0], self.k)), "text": text}

    def linked(self, a: dict, b: dict) -> bool:
        x, y = a["hashed"], b["hashed"]
        common = len(np.intersect1d(x, y, assume_unique=True)) + 2  # room for hashes that collide
        if 100 * common < self.percent * (len(x) + len(y) - common):
            return False
        for d in (a, b):
            if "set" not in d:
                d["set"] = shingles_of(words_of(d["text"]), self.k)
        common = len(a["set"] & b["set"])
        return common > 0 and 100 * common >= self.percent * (len(a["set"]) + len(b["set"]) - common)


def _columns(rows: pa.StructArray, hashes: int, bands: int) -> dict[str, np.ndarray]:
    out = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "n")}
    out["sig"] = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(-1, hashes)
    out["marks"] = rows.field("marks").flatten().to_numpy().reshape(-1, bands)
    return out


def _candidates(m: dict, o: dict, i: int, mark: int, steps: list[tuple[int, int]], percent: int) -> np.ndarray:
    """Members of a bucket that the i-th of the others may link with, the likeliest first.

    Those of its own component, of sizes too far apart, or with an earlier mark in common (that bucket compares the pair) are left out.
    """
    low, high = np.minimum(m["n"], o["n"][i]), np.maximum(m["n"], o["n"][i])
    near = np.flatnonzero((m["comp"] != o["comp"][i]) & (100 * low >= percent * high))
    live, matched = _survive(m["sig"][near], np.broadcast_to(o["sig"][i], (len(near), o["sig"].shape[1])), steps)
    near = near[live]
    same = m["marks"][near] == o["marks"][i]
    first = o["marks"][i][same.argmax(axis=1)] == mark
    return near[first][np.argsort(-matched[first], kind="stable")]


def minhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, miss: float = 1e-7, batch: int = 40, star_rounds: int = 1, block: int = 128
) -> DataFrame:
    """Columns id_col, n_shingles, component_id, kept: one row per input row.

    Linked: 100 * intersection >= percent * union of the shingle sets. With 40 bands of 5 rows a pair at
    similarity 0.8 shares no band with probability 1e-7; miss is the posterior bound of the pruning.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashes, steps = bands * rows, least_matches(bands * rows, batch, percent / 100, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in batches:
            ns, keys, sigs, marks = [], [], [], []
            h, at = word_hashes([x.as_py() or b"" for x in b.column(1).cast(pa.binary())])
            for i in range(b.num_rows):
                s = np.unique(shingles(h[at[i] : at[i + 1]], k))
                ns.append(len(s))
                if len(s):
                    v = signer.values(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append((v >> np.uint32(24)).astype(np.uint8).tobytes())  # values that collide only keep more pairs
                    marks.append(signer.band_keys(v))
                else:
                    keys.append(None), sigs.append(None), marks.append(None)
            yield pa.record_batch([b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["id", "n", "key", "sig", "marks"])

    signed = scratch.write(base.mapInArrow(sign, "id long, n long, key binary, sig binary, marks array<long>"), "signed")
    classes = scratch.write(signed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "classes")
    # From here on the smallest member stands for its class.
    reps = signed.join(classes.select(F.col("rep").alias("id"), "key"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("id", "n", "sig", "marks")
    reps = scratch.write(reps, "reps")
    scratch.release()
    marked = reps.select("id", F.explode("marks").alias("mark"))
    shared = scratch.write(marked.groupBy("mark").agg(F.count("*").alias("size"), F.min("id").alias("v")).where("size > 1"), "shared")
    buckets = scratch.write(join_unique(marked, with_hot(shared, "size"), "mark", "inner").select("mark", "id", "size", "v"), "buckets")
    scratch.release()
    signature = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, hashes) for c in ("su", "sv"))
                live, matched = _survive(x, y, steps)
                yield pa.record_batch([*b.select(["u", "v"]).take(pa.array(live)).columns, pa.array(matched)], ["u", "v", "matched"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (v, s, id, text) by v and s, the text of v itself first."""
        c, now, own = Confirmer(k, percent), None, []
        for b in batches:
            keep = []
            for i, (v, s, u, text) in enumerate(zip(*(x.to_pylist() for x in b.columns), strict=True)):
                if (v, s) != now:
                    now, own = (v, s), []
                d = c.read(text)
                if u == v:
                    own.append(d)
                elif any(c.linked(d, x) for x in own):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([b.column(2).take(at), b.column(0).take(at)], ["u", "v"])

    def confirm(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (u, v): of each u the likeliest pair that no batch of the signatures prunes, if its full sets say so."""
        centres = scratch.write(pairs.groupBy("v").agg(F.count("*").alias("c")), "centres")
        both = join_unique(pairs.join(signature("u"), "u"), with_hot(centres, "c").drop("c").join(signature("v"), "v"), "v", "inner")
        both = both.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v", "su", "sv")
        best = both.mapInArrow(prune, "u long, v long, matched long").groupBy("u").agg(F.max(F.struct("matched", -F.col("v"))).alias("b"))
        left = scratch.write(best.select("u", (-F.col("b.col2")).alias("v")), "left")
        # Each text goes where its centre is compared; a centre of many is copied to several places.
        places = scratch.write(left.groupBy("v").agg(F.count("*").alias("c"), F.ceil(F.count("*") / SPLIT).alias("places")), "places")
        to = join_unique(left, with_hot(places, "c"), "v", "inner").select(F.col("u").alias("id"), "v", F.pmod(F.xxhash64("u"), F.col("places")).alias("s"))
        to = to.unionByName(places.select(F.col("v").alias("id"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("s")))
        # Texts are shuffled to their ids whatever the number of targets, so that a small table is planned like a large one.
        met = base.join(scratch.write(to, "targets").hint("merge"), "id").select("v", "s", "id", "text").repartition("v", "s").sortWithinPartitions("v", "s", F.col("id") != F.col("v"))
        links = scratch.write(met.mapInArrow(verify, "u long, v long"), "links")
        scratch.release()
        return links

    pairs = buckets.where("id <> v").select(F.col("id").alias("u"), "v").distinct()
    labels = scratch.write(connected_components(confirm(pairs), scratch), "labels")

    def open_buckets(salt: int) -> DataFrame:
        """Rows of the buckets that still span components, with another centre each."""
        labelled = buckets.select("mark", "id").join(labels, "id", "left").select("mark", "id", F.coalesce("comp", "id").alias("comp"))
        spans = labelled.groupBy("mark").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("id", "mark", F.lit(salt)), "id", "comp")).alias("c")).where("lo <> hi")
        spans = with_hot(scratch.write(spans.select("mark", "size", F.col("c.id").alias("v"), F.col("c.comp").alias("vcomp")), "spans"), "size").drop("size")
        return join_unique(labelled, spans, "mark", "inner").select("mark", "id", "comp", "v", "vcomp")

    for salt in range(star_rounds):
        left = scratch.write(open_buckets(salt).where("comp <> vcomp").select(F.col("id").alias("u"), "v").distinct(), "star")
        if is_empty(left):
            break
        new = confirm(left)
        if is_empty(new):
            break
        labels = scratch.write(connected_components(new.union(labels.select("id", "comp")), scratch), "labels")

    def blocks(left: DataFrame, payload: DataFrame, names: list[str], function: Callable, schema: str) -> DataFrame:
        """function over (mark, members, others) of all pairs of chunks of each bucket of left (mark, id, comp); others are those outside its largest component."""
        counts = left.groupBy("mark", "comp").agg(F.count("*").alias("c")).groupBy("mark").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"))
        counts = counts.select("mark", F.col("top.comp").alias("main"), F.ceil(F.col("size") / block).alias("xs"), F.ceil((F.col("size") - F.col("top.c")) / block).alias("ys"), "size").where("ys > 0")
        counts = with_hot(scratch.write(counts, "counts"), "size").drop("size")
        dealt = join_unique(left, counts, "mark", "inner").join(payload, "id")
        chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        packed = F.collect_list(F.struct("id", "comp", *names))
        members = dealt.select("*", chunk("xs").alias("x"), copies("ys").alias("y")).groupBy("mark", "x", "y").agg(packed.alias("m"))
        others = dealt.where("comp <> main").select("*", chunk("ys").alias("y"), copies("xs").alias("x")).groupBy("mark", "x", "y").agg(packed.alias("o"))
        return members.join(others, ["mark", "x", "y"]).select("mark", "m", "o").mapInArrow(function, schema)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of a block that its signatures leave a pair."""
        for b in batches:
            for mark, m, o in zip(*b.columns, strict=True):
                m, o = (_columns(x.values, hashes, bands) for x in (m, o))
                found = set()
                for i in range(len(o["id"])):
                    near = _candidates(m, o, i, mark.as_py(), steps, percent)
                    found |= {int(o["id"][i]), *m["id"][near].tolist()} if len(near) else set()
                yield pa.record_batch([pa.array([mark.as_py()] * len(found), pa.int64()), pa.array(sorted(found), pa.int64())], ["mark", "id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that join components, at most one for each pair of components of the block."""
        c = Confirmer(k, percent)
        for b in batches:
            for mark, m, o in zip(*b.columns, strict=True):
                texts, others = (x.values.field("text").to_pylist() for x in (m, o))
                m, o = (_columns(x.values, hashes, bands) for x in (m, o))
                known: dict[int, dict] = {}
                links, joined = [], set()
                for i in range(len(o["id"])):
                    near, own, mine = _candidates(m, o, i, mark.as_py(), steps, percent), None, int(o["comp"][i])
                    for j in near.tolist():
                        if (mine, int(m["comp"][j])) in joined:
                            continue
                        own = own or c.read(others[i])
                        if j not in known:
                            known[j] = c.read(texts[j])
                        if c.linked(own, known[j]):
                            joined |= {(mine, int(m["comp"][j])), (int(m["comp"][j]), mine)}
                            links.append((int(o["id"][i]), int(m["id"][j])))
                yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["u", "v"])

    left = scratch.write(open_buckets(star_rounds).select("mark", "id", "comp"), "open")
    if not is_empty(left):
        names = ["n", "sig", "marks"]
        flagged = scratch.write(blocks(left, reps, names, flag, "mark long, id long").distinct(), "flagged")
        if not is_empty(flagged):
            # Texts go to the buckets only of documents that have a pair there.
            texts = base.join(flagged.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
            found = blocks(left.join(flagged, ["mark", "id"], "left_semi"), reps.join(texts, "id"), [*names, "text"], compare, "u long, v long").distinct()
            labels = scratch.write(connected_components(found.union(labels.select("id", "comp")), scratch), "labels")

    known = classes.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"), "members")
    known = scratch.write(known, "known")
    scratch.keep(signed, known)
    out = join_unique(signed.where("key is not null").select("id", "n", "key"), with_hot(known, "members").drop("members"), "key", "inner").select("id", "n", "comp")
    out = out.unionByName(signed.where("key is null").select("id", "n", F.col("id").alias("comp")))
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
