"""Embedding near-dedup over an inverted multi-index.

Vectors that are equal at length one are a class first; one of each class is compared. Unit vectors are cut into two halves, and a
codebook is fitted to each half on a bounded sample; a vector's cell in the grid of their products is the pair of its nearest
words. The number of words grows with the table, so cells stay small. Every vector is a query: the two lists of words, each in the order
of the distance to the word's half-space, are walked by a multi-sequence traversal (a heap over their product, nearest cell first). A
partner at exactly the wanted cosine goes a normal step along any axis, which gives each cell its chance to hold it, and the walk stops
for each query where the cells visited hold a target share of the query's chances. A pair is found if either side's walk reaches the other's cell, and counted once for both. The target share is calibrated on the sample: partners drawn around
sampled vectors, and the links within the sample, are found with a frequency of `recall`. With recall 1 every cell whose
half-spaces are near enough to hold a partner is visited, which is exact.

Visits are verified exactly in double precision, in blocks. The vectors of a cell and its visitors are dealt into chunks, and pairs
of chunks over tasks, so a cell that holds a third of all rows is many tasks; each pair of chunks gives counts of links and a spanning
forest of its links, never the links themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors
of different lengths never link; each length has codebooks of its own (one cell, which is exact, where the sample has too few of it). A pair
whose cosine is exactly the threshold links. An id names one vector: rows that repeat it count once, with the least of their vectors, and each
is returned. A null id links with nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, connected_components, hash_sample, join_unique, with_hot

#: Absolute slack of the bounds against rounding.
SLACK = 1e-7
#: Vectors that a cell should hold, and the most words of a half.
CELL, MOST_WORDS = 128, 2048
#: Asked chunks that meet one held chunk in a task.
CHUNKS = 32
#: Bits of a cell's number for each half's word.
BITS = 20


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return np.unique(c, axis=0)


def _unit(b: pa.RecordBatch, column: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions of the usable vectors, and those vectors at length one."""
    rows: dict[int, list] = {}
    for i, v in enumerate(b.column(column).to_pylist()):
        if v and None not in v:
            rows.setdefault(len(v), []).append((i, v))
    out = {}
    for dim, held in rows.items():
        x = np.array([v for _, v in held], np.float64)
        top = np.abs(x).max(1)
        good = np.isfinite(x).all(1) & (top > 0)
        x = x[good] / top[good][:, None]  # else squares of very large or small components are lost
        out[dim] = np.array([i for i, _ in held])[good], x / np.sqrt((x * x).sum(1))[:, None]
    return out


class Grid:
    """The codebooks of one length; bounded by MOST_WORDS, so it travels with the tasks."""

    def __init__(self, fit: np.ndarray, words: int, cosine: float, recall: float, seed: int):
        self.dim, self.cosine = fit.shape[1], cosine
        self.cut = self.dim // 2
        self.books = [_kmeans(half, words, seed + i) if words > 1 and half.shape[1] else half[:1] * 0 for i, half in enumerate((fit[:, : self.cut], fit[:, self.cut :]))]
        self.apart = [np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 0)) for c in self.books]
        # A partner in a random direction goes so far along an axis (one standard deviation).
        self.step = np.sqrt(max(1 - cosine**2, 1e-12) / max(self.dim - 1, 1))
        self.share = 1.0
        if recall < 1 and self.dim >= 8 and max(map(len, self.books)) > 1:
            self.share = self._calibrated(fit[:2000], recall, seed + 2)

    def _half(self, x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest word; for each word the distance to its half-space, and the share of partners that this distance leaves it."""
        c, apart = self.books[half], self.apart[half]
        d = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)
        near = d.argmin(1)
        gap = apart[near]
        far = np.divide(d - d[np.arange(len(x)), near][:, None], 2 * gap, out=np.zeros_like(d), where=gap > 0)
        chance = np.exp(-((far / self.step) ** 2) / 2) + 1e-300
        return near, np.maximum(far - SLACK, 0), chance / chance.sum(1)[:, None]

    def traverse(self, a: np.ndarray, b: np.ndarray, share: float) -> tuple[list[int], list[float]]:
        """Cells (word of a, word of b) from the nearest, that is, by falling chance, until they hold `share` of it, and what was held before each."""
        i, j = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        p, q = a[i].tolist(), b[j].tolist()
        heap, cells, before, held = [(-p[0] * q[0], 0, 0)], [], [], 0.0
        while heap and held < share:
            chance, m, n = heappop(heap)
            cells.append(i[m] << BITS | j[n]), before.append(held)
            held -= chance
            if n + 1 < len(q):
                heappush(heap, (-p[m] * q[n + 1], m, n + 1))
            if not n and m + 1 < len(p):
                heappush(heap, (-p[m + 1] * q[0], m + 1, 0))
        return cells, before

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell, and the cells to visit in order."""
        n1, f1, a = self._half(x[:, : self.cut], 0)
        n2, f2, b = self._half(x[:, self.cut :], 1)
        if self.share < 1:
            return n1 << BITS | n2, [self.traverse(p, q, self.share)[0] for p, q in zip(a, b, strict=True)]
        reach, visit = 2 - 2 * self.cosine + SLACK, []
        for p, q in zip(f1 * f1, f2 * f2, strict=True):
            order = np.argsort(q, kind="stable")
            ends = np.searchsorted(q[order], reach - p, side="right")
            visit.append([m << BITS | n for m in np.flatnonzero(ends).tolist() for n in order[: ends[m]].tolist()])
        return n1 << BITS | n2, visit

    def _calibrated(self, x: np.ndarray, recall: float, seed: int) -> float:
        """The least share at which either side of a fraction `recall` of the pairs reaches the other's cell."""
        r = np.random.default_rng(seed)
        u = r.normal(size=x.shape)
        u -= (u * x).sum(1)[:, None] * x
        u /= np.maximum(np.sqrt((u * u).sum(1)), 1e-12)[:, None]
        y = self.cosine * x + np.sqrt(max(0.0, 1 - self.cosine**2)) * u
        reached = []
        for z in (x, y):
            own = self._half(z[:, : self.cut], 0)[0] << BITS | self._half(z[:, self.cut :], 1)[0]
            a, b = self._half(z[:, : self.cut], 0)[2], self._half(z[:, self.cut :], 1)[2]
            reached.append((own, [dict(zip(*self.traverse(p, q, 0.9999), strict=True)) for p, q in zip(a, b, strict=True)]))
        (own_x, from_x), (own_y, from_y) = reached
        drawn = [min(f.get(int(cy), 1.0), g.get(int(cx), 1.0)) for f, g, cx, cy in zip(from_x, from_y, own_x, own_y, strict=True)]
        a, b = np.nonzero(np.triu(x @ x.T >= self.cosine, 1))
        real = [min(from_x[i].get(int(own_x[j]), 1.0), from_x[j].get(int(own_x[i]), 1.0)) for i, j in zip(a[:50_000].tolist(), b[:50_000].tolist(), strict=True)]
        need = max(float(np.quantile(s, recall, method="higher")) for s in (drawn, real) if len(s))
        return min(need + 1e-9, 1.0)


def _forest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever the links of this block connect: each node to the least id that it reaches."""
    r, c = link.any(1), link.any(0)
    link, rows, cols = link[np.ix_(r, c)], rows[r], cols[c]
    a, b, top = rows.copy(), cols.copy(), np.iinfo(np.int64).max
    while len(rows):
        na = np.minimum(a, np.where(link, b[None, :], top).min(1))
        nb = np.minimum(b, np.where(link, na[:, None], top).min(0))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    return np.concatenate([rows, cols]), np.concatenate([a, b])


def _block(held: pa.StructArray, asked: pa.StructArray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links of each) and (u, v) edges of a spanning forest, of a held and an asked chunk of a cell."""
    (hi, hn), (ai, an) = ([s.field(f).to_numpy(zero_copy_only=False) for f in ("id", "n")] for s in (held, asked))
    h, a = (np.frombuffer(b"".join(s.field("v").to_pylist()), np.float64).reshape(len(s), -1) for s in (held, asked))
    link = a @ h.T >= cosine
    link &= ai[:, None] != hi[None, :]
    # A link whose held side visits the asked side's cell as well is counted there for the held side.
    homes, home = np.unique(asked.field("home").to_numpy(zero_copy_only=False), return_inverse=True)
    visits = held.field("visit")
    at = np.repeat(np.arange(len(held)), np.diff(visits.offsets.to_numpy()))
    cell = visits.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(homes, cell), len(homes) - 1)
    known = np.zeros((len(held), len(homes)), bool)
    known[at[homes[place] == cell], place[homes[place] == cell]] = True
    alone = link & ~known[:, home].T
    counts = np.concatenate([link @ hn, an @ alone])
    ids = np.concatenate([ai, hi])
    return ids[counts > 0], counts[counts > 0], *_forest(link, ai, hi)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.999, words: int | None = None, sample: int = 8192, block: int = 512, seed: int = 7) -> DataFrame:
    """Columns id_col, n_links, component_id, kept: one row per input row.

    Codebooks are fitted on at most `sample` rows, with `words` words for each half or, where None, so many that a cell holds about CELL vectors.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "embed")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    total = base.count()
    fit: dict[int, list[np.ndarray]] = {}
    for b in hash_sample(base.where("id is not null"), [F.col("id")], sample, total).toArrow().to_batches():
        for dim, (_, x) in _unit(b, 1).items():
            fit.setdefault(dim, []).append(x)
    drawn = sum(len(x) for parts in fit.values() for x in parts)
    grids = {}
    for dim, parts in fit.items():
        x = np.concatenate(parts)
        grown = int(np.ceil(np.sqrt(total * len(x) / max(drawn, 1) / CELL)))
        own = words or min(MOST_WORDS, grown)
        if len(x) >= 64:
            grids[dim] = Grid(x, min(own, len(x) // 4), cosine, recall, seed)
    shared = spark.sparkContext.broadcast(grids)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _unit(b, 1).values():
                yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "v"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(v.as_py()) // 8 for v in b.column(2)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = np.frombuffer(b"".join(v.as_py() for v in b.column(2).take(pa.array(at))), np.float64).reshape(len(at), dim)
                for i in range(0, len(at), 64):
                    part = b.take(pa.array(at[i : i + 64]))
                    own, visit = shared.value[dim].cells(x[i : i + 64]) if dim in shared.value else (np.zeros(part.num_rows, np.int64), [[0]] * part.num_rows)
                    own, visit = own + (dim << 2 * BITS), [[c + (dim << 2 * BITS) for c in v] for v in visit]
                    yield pa.record_batch([*part.columns, pa.array(own, pa.int64()), pa.array(visit, pa.list_(pa.int64()))], ["id", "n", "v", "cell", "visit"])

    single = base.where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    units = scratch.write(single.mapInArrow(unit, "id long, v binary"), "units")
    classes = units.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "v")
    indexed = scratch.write(classes.mapInArrow(index, "id long, n long, v binary, cell long, visit array<long>"), "indexed")
    asked = indexed.select("id", "n", F.col("cell").alias("home"), F.explode("visit").alias("cell"), "v")
    # Chunks of each cell: its vectors' (x), its visitors', and the groups of these that meet a held chunk in one task (z).
    sizes = indexed.select("cell", F.lit(1).alias("h"), F.lit(0).alias("a")).unionByName(indexed.select(F.explode("visit").alias("cell"), F.lit(0).alias("h"), F.lit(1).alias("a")))
    sizes = sizes.groupBy("cell").agg(F.sum("h").alias("held"), F.sum("a").alias("asked")).where("held > 0 and asked > 0")
    sizes = sizes.select("cell", F.ceil(F.col("held") / block).alias("xs"), F.ceil(F.col("asked") / block).alias("ys"), (F.col("held") + F.col("asked")).alias("rows"))
    sizes = with_hot(scratch.write(sizes, "sizes"), "rows")
    sizes = sizes.withColumn("zs", F.ceil(F.col("ys") / CHUNKS)).drop("rows")
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = ["cell", "x", "z"]
    # Each side is shuffled once, by what the chunks are joined on; chunks are put together where they are joined.
    held = join_unique(indexed, sizes, "cell", "inner").select("cell", chunk("xs").alias("x"), spread("zs").alias("z"), F.struct("id", "n", "v", "visit").alias("row"))
    asked = join_unique(asked, sizes, "cell", "inner").withColumn("y", chunk("ys")).select("cell", spread("xs").alias("x"), (F.col("y") % F.col("zs")).alias("z"), "y", F.struct("id", "n", "v", "home").alias("row"))
    held = held.repartition(*deal).groupBy(*deal).agg(F.collect_list("row").alias("held"))
    asked = asked.repartition(*deal).groupBy(*deal, "y").agg(F.collect_list("row").alias("asked"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, a in zip(b.column(0), b.column(1), strict=True):
                for i in range(0, len(a.values), 1024):
                    ids, counts, u, v = _block(h.values, a.values.slice(i, 1024), cosine)
                    no_edge = pa.nulls(len(ids), pa.int64())
                    yield pa.record_batch([pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(u, pa.int64())]), pa.concat_arrays([no_edge, pa.array(v, pa.int64())]), pa.array(np.concatenate([counts, np.zeros(len(u))]).astype(np.int64))], ["id", "v", "n"])

    met = held.join(asked, deal).select("held", "asked").mapInArrow(verify, "id long, v long, n long")
    met = scratch.write(met.groupBy("id", "v").agg(F.sum("n").alias("n")), "met")
    comps = scratch.write(connected_components(met.where("v is not null").select(F.col("id").alias("u"), "v"), scratch), "labels")
    links = met.where("v is null").select("id", F.col("n").alias("links"))
    reps = indexed.select("id", "n", F.md5("v").alias("key")).join(links, "id", "left").join(comps, "id", "left").select("key", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "id").alias("comp"))
    members = join_unique(units.select("id", F.md5("v").alias("key")), with_hot(scratch.write(reps, "reps"), "n"), "key", "inner").select("id", (F.col("links") + F.col("n") - 1).alias("n_links"), "comp")
    out = base.select("id").join(members, "id", "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
