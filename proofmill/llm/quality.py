"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words. Each passage is encoded by shape statistics and a hashed
projection of its words; a hidden layer, gated attention (tanh times sigmoid) and a logistic output are learned
from document labels alone, so the attention finds the passages that decide. A document's score
is the logistic of the attention-weighted mean of all its passages, whatever their number.

Training uses at most `sample` labelled rows (the smallest hashes of doc_id) and of each at most `passages` of its passages, spread evenly over
the whole text; their features are collected to the driver: a bound that does not grow with the input or the lengths of texts. Scoring is a single
pass over the text and takes all passages.

Defined results: a null or blank text is a bag of one empty passage. Rows that repeat a doc_id are scored
one by one; several labels of a doc_id count as their mean. Without any label every score is 0.5. A score of exactly the threshold
is kept. Columns besides the id and the text are not read, whatever their names, and come back unchanged where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_sample, held_out
from .hashing import BASE as _BASE
from .hashing import INVERSE as _INVERSE
from .hashing import mixed, power

PASSAGE = 64
#: Code points encoded at once.
BLOCK = 1 << 18
HASHED = 64
STATS = 21
SIZE = STATS + HASHED
_FIELDS = np.array([[0, 1, 1 << 21, 1 << 42, 0, 0], [0, 0, 0, 0, 1, 1 << 21]])
_tables: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 sentence mark, 5 anything else."""
    if not _tables:
        out = np.full(0x30000, 5, np.int8)
        for c in range(0x30000):
            x = chr(c)
            if x.isspace():
                out[c] = 0
            elif x.isupper():
                out[c] = 2
            elif x.isalpha():
                out[c] = 1
            elif x.isdigit():
                out[c] = 3
        out[[ord(c) for c in ".,;:?'\"()-"]] = 4
        _tables.append(out)
    return _tables[0]


def _per_word(text: str) -> dict[str, np.ndarray]:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.minimum(code, 0x2FFFF)]
    inside = np.concatenate([[False], kind > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = lambda x: np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
    low = (1 << 21) - 1
    if len(code) <= low:  # counts of the kinds fit fields of 21 bits
        one, two = (sums(field[kind]) for field in _FIELDS)
        one, two = one[end] - one[start], two[end] - two[start]
        held = [one & low, one >> 21 & low, one >> 42, two & low, two >> 21]
    else:
        counts = (sums((kind == k).astype(np.int64)) for k in range(1, 6))
        held = [c[end] - c[start] for c in counts]
    with np.errstate(over="ignore"):
        terms = sums((code.astype(np.uint64) + np.uint64(1)) * power(_BASE, len(code)))
        word = mixed((terms[end] - terms[start]) * power(_INVERSE, len(code) + 1)[start])
    breaks = np.concatenate([[0], np.cumsum(code == 10)])
    return {
        "len": end - start, **dict(zip(("lower", "upper", "digit", "mark", "other"), held, strict=True)),
        "word": word, "first": kind[start], "last": kind[end - 1], "stop": np.isin(code[end - 1], [46, 33, 63]), "bang": code[end - 1] == 33, "line": np.diff(breaks[end], prepend=0) > 0,
    }


def encode(text: str | None) -> np.ndarray:
    """One row of features for each passage of the whole text; one row of zeros if it has no word."""
    text = text or ""
    parts, at = [], 0
    while at < len(text):
        cut = at + BLOCK
        while cut < len(text) and not text[cut].isspace():
            cut += 1
        parts.append(_per_word(text[at:cut]))
        at = cut
    parts = [p for p in parts if len(p["len"])]
    if not parts:
        return np.zeros((1, SIZE), np.float32)
    w = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n = len(w["len"])
    starts = np.arange(0, n, PASSAGE)
    size = np.diff(np.concatenate([starts, [n]])).astype(np.float64)
    total = lambda x: np.add.reduceat(np.asarray(x, np.float64), starts)
    chars = total(w["len"])
    place = np.arange(n) // PASSAGE
    same = np.concatenate([[False], w["word"][1:] == w["word"][:-1]])

    def distinct(h: np.ndarray, where: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, where))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (where[order][1:] != where[order][:-1])])
        return np.bincount(where[order][new], minlength=len(starts)) / size

    with np.errstate(over="ignore"):
        pair = mixed(w["word"] * np.uint64(3) + np.roll(w["word"], -1))
    _, back, often = np.unique(pair, return_inverse=True, return_counts=True)
    letters = total(w["lower"] + w["upper"])
    stats = np.stack(
        [
            chars / size / 6, total(w["len"] ** 2) / size / 60, total(w["upper"]) / np.maximum(letters, 1), total(w["digit"]) / chars, total(w["mark"]) / chars, total(w["other"]) / chars,
            total((w["upper"] == w["len"]) & (w["len"] > 1)) / size, total((w["upper"] > 1) & (w["lower"] == 0)) / size, total(w["lower"] + w["upper"] == 0) / size, total(w["other"] > 0) / size, total(w["last"] == 5) / size, total(w["last"] == 4) / size,
            total(w["first"] == 2) / size, total(w["stop"]) / size, total(w["bang"]) / size, total(w["line"]) / size, total(same) / size, distinct(w["word"], place), distinct(pair, place),
            total(often[back] > 1) / size, total(w["len"] <= 3) / size,
        ],
        axis=1,
    )
    bits = np.unpackbits(w["word"].view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
    hashed = np.add.reduceat(bits, starts, axis=0) / np.sqrt(size)[:, None] / 4
    return np.concatenate([stats, hashed], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """The network: parameters as arrays, forward and backward passes over a batch of bags."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(SIZE), np.ones(SIZE)
        self.p = {"W": draw(SIZE, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(np.concatenate([starts, [len(x)]]))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"n": n, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, starts)
        out = (f["y"] - label) / len(label)
        dz = np.repeat(out[:, None] * p["c"], f["n"], axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["n"]))
        dg = de[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        pre = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ pre, "b": pre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ out, "d": np.array([out.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Attention:
        r = np.random.default_rng(seed)
        every = np.concatenate(bags).astype(np.float64)
        self.mean[:STATS], self.scale[:STATS] = every[:, :STATS].mean(0), every[:, :STATS].std(0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                x = np.concatenate([bags[i] for i in take])
                starts = np.cumsum([0] + [len(bags[i]) for i in take[:-1]])
                step += 1
                for k, g in self.gradient(x, starts, labels[take]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * self.p[k])
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, starts)["y"]


def learn_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, passages: int = 256) -> Attention | float:
    """Fit on at most `sample` labelled documents that are not held out; a constant where the labels have one class only."""
    bounded_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null").where(~held_out(F.col("id")))
    chosen = hash_sample(marked.groupBy("id").agg(F.avg("label").alias("label")), [F.col("id")], sample, marked.count())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [bag[np.unique(np.linspace(0, len(bag) - 1, passages).astype(np.int64))].tobytes() for bag in map(encode, b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(made, pa.binary())], ["id", "label", "bag"])

    kind = rows.schema["id"].dataType.simpleString()
    bags = rows.mapInArrow(features, f"id {kind}, label double, bag binary").groupBy("id", "label").agg(F.min("bag").alias("bag"))  # one for rows that repeat an id
    got = sorted((r.id, r.label, bytes(r.bag)) for r in bags.collect())
    y = np.array([label for _, label, _ in got])
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    return Attention().fit([np.frombuffer(x, np.float32).reshape(-1, SIZE) for _, _, x in got], y)


def _scores(texts: list[str | None], model: Attention | float) -> np.ndarray:
    if not isinstance(model, Attention):
        return np.full(len(texts), model)
    return np.concatenate([np.empty(0), *(model.score([encode(t) for t in texts[at : at + 64]]) for at in range(0, len(texts), 64))])


def score_quality(docs: DataFrame, model: Attention | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Columns id_col, held_out, score, predicted: one row per input row."""
    bounded_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _scores(b.column(2).to_pylist(), model)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(y), pa.array((y >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string"))
    return rows.mapInArrow(score, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: Attention | float, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    bounded_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            yield b.filter(pa.array(_scores(texts, model) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
