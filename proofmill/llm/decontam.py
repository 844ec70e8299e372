"""Benchmark decontamination: every training passage is a BM25 query against an index of the test items.

The inverted index holds, for each word, the BM25 weight in each item over the item's score against itself, so one
threshold is a share of any item. Items are put in blocks of 8 with the largest weight of each word in a block.
A document's passages (windows twice as long as the longest item, half overlapping, so that any copy of an item lies in one)
are the queries. Block-max WAND: a passage's lists are ordered from the longest, and the pivot is the first at which the sum of the
lists' largest weights reaches the threshold; no item of the lists before it alone can be retrieved, so only the blocks of the lists from the pivot on are
candidates, and the others are skipped to those blocks. A candidate block is dropped unless the sum of the words' largest weights in it
reaches the threshold; items of the others are scored exactly, and all at or above the threshold are retrieved. The bounds never fall below a
score, so nothing is lost. A hit counts as contamination if both parts of the whole item overlap with the
passage: the question (all sentences but the last) and the answer (the last) by their share of word
3-grams and word pairs.

Words are compared in lower case (A-Z) and without ASCII punctuation. Items of up to LONGEST_ITEM words share an index; longer ones are
put in classes of lengths up to twice as long, each with passages of its own length. The indexes travel by broadcast in shards of at most `shard_bytes` of item
text; a larger benchmark makes more shards and more passes, never a larger broadcast. Document frequencies and the mean length are those of all items, so
scores do not depend on the shards.

Defined results: null or blank texts match nothing, and items without words are matched by nothing. Repeated rows
match alike. An item is a distinct pair of id and text: items that share an id, or have none, are each matched and reported
under that id (null where there is none); rows that repeat a pair count once. With an empty benchmark nothing matches. A score or overlap
of exactly the threshold counts; of several passages that hold an item the best (score, then overlaps) is reported. Texts of any length
are queried whole. Other columns are not read, whatever their names, and come back unchanged where rows are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, LongType

from .common import Scratch, bounded_batches
from .hashing import word_hashes

BLOCK_ITEMS, LONGEST_ITEM = 8, 256
K1, B = 1.2, 0.75
#: Postings looked at together.
POSTINGS = 1 << 20


#: A-Z to a-z, ASCII punctuation to blanks.
_PLAIN = bytes(32 if 32 < c < 127 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


def _grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if n else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words before the last sentence, and of it; the last third of the words where there is one sentence only."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if len(parts) > 1:
        return _words(" ".join(parts[:-1])), _words(parts[-1])
    words = _words(text)
    cut = max(1, len(words) - max(1, len(words) // 3))
    return words[:cut], words[cut:]


def _class(words: int) -> int:
    """0 for items of up to LONGEST_ITEM words, 1 for up to twice as many, and so on."""
    return max(0, (max(words, 1) - 1).bit_length() - (LONGEST_ITEM - 1).bit_length())


class Statistics:
    """Over all items: their number, their mean length, the longest of each class, and in how many of them each word is (by ascending hash)."""

    def __init__(self, items: int, mean: float, lengths: Iterable[int], words: np.ndarray, found_in: np.ndarray):
        self.items, self.mean, self.words, self.found_in = items, mean, words, found_in
        self.longest: dict[int, int] = {}
        for n in lengths:
            self.longest[_class(n)] = max(n, self.longest.get(_class(n), 0))

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        """For items that are all at hand."""
        h, at = word_hashes([b" ".join(_words(t)) for t in texts])
        n = np.diff(at)
        pairs = np.unique(np.stack([h, np.repeat(np.arange(len(texts), dtype=np.uint64), n)]), axis=1)
        return Statistics(int((n > 0).sum()), float(n[n > 0].mean()) if n.any() else 1.0, n.tolist(), *np.unique(pairs[0], return_counts=True))


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... for each of the ranges of n, and whose each is."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n), np.repeat(np.arange(len(n)), n)


class ItemIndex:
    """Postings of items of one class of lengths: by word, the items and blocks that have it, with their weights."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        s = statistics or Statistics.of([t for _, t in items])
        held = sorted(((i, t, w) for i, t in items if (w := _words(t))), key=lambda x: (len(x[2]), x[0]))
        self.items = [i for i, _, _ in held]
        self.parts = [(_grams(q, 3), _grams(a, 2)) for q, a in (question_and_answer(t) for _, t, _ in held)]
        self.stride = max([32, *(s.longest[_class(len(w))] for _, _, w in held)])
        h, at = word_hashes([b" ".join(w) for _, _, w in held])
        length, n = np.diff(at), len(held)
        self.vocabulary, term = np.unique(h, return_inverse=True)
        pairs, tf = np.unique(term * max(n, 1) + np.repeat(np.arange(n), length), return_counts=True)
        self.p_keys, p_term, p_item = pairs, pairs // max(n, 1), pairs % max(n, 1)
        df = s.found_in[np.searchsorted(s.words, self.vocabulary)] if n else np.empty(0)
        idf = np.log(1 + (s.items - df + 0.5) / (df + 0.5))
        w = idf[p_term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[p_item] / s.mean))
        self.p_weight = w / np.bincount(p_item, w, minlength=n)[p_item]
        self.blocks = max(1, -(-n // BLOCK_ITEMS))
        keys = p_term * self.blocks + p_item // BLOCK_ITEMS
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.b_keys = keys[new]
        self.b_most = np.maximum.reduceat(self.p_weight, new) if len(new) else np.empty(0)
        self.b_offset = np.searchsorted(self.b_keys, np.arange(len(self.vocabulary) + 1) * self.blocks)
        self.most = np.maximum.reduceat(self.b_most, self.b_offset[:-1]) if n else np.empty(0)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def retrieve(self, texts: list[bytes], threshold: float) -> list[tuple[int, int, int, float]]:
        """(text, first word of the passage, place of the item, score) of every passage and item at or above the threshold."""
        out: list[tuple[int, int, int, float]] = []
        if not self.items:
            return out
        h, at = word_hashes([t.translate(_PLAIN) for t in texts])
        near = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        term = np.searchsorted(self.vocabulary, h[near])
        known = self.vocabulary[np.minimum(term, len(self.vocabulary) - 1)] == h[near]
        near, term = near[known], term[known]
        text = np.searchsorted(at, near, side="right") - 1
        step = (near - at[text]) // self.stride
        first = np.concatenate([[0], np.cumsum(np.diff(at) // self.stride + 1)])  # passages of the texts before
        passage = first[text] + step
        # A word in the n-th stride is in the passages that begin at strides n and n - 1.
        earlier = step > 0
        keys = np.unique(np.concatenate([passage, passage[earlier] - 1]) * len(self.vocabulary) + np.concatenate([term, term[earlier]]))
        passage, term = keys // len(self.vocabulary), keys % len(self.vocabulary)
        # Passages in groups of a bounded number of postings; one passage's are bounded by the index.
        begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.empty(0, np.int64)
        size = np.cumsum((self.b_offset[term + 1] - self.b_offset[term]) + 1)
        low = 0
        while low < len(begins):
            done = size[begins[low] - 1] if begins[low] else 0
            high = max(low + 1, int(np.searchsorted(size[np.append(begins[1:], len(term)) - 1], done + POSTINGS, side="right")))
            a, b = int(begins[low]), int(begins[high]) if high < len(begins) else len(term)
            for p, place, score in zip(*self._wand(passage[a:b], term[a:b], threshold), strict=True):
                i = int(np.searchsorted(first, p, side="right")) - 1
                out.append((i, int(p - first[i]) * self.stride, int(place), float(score)))
            low = high
        return out

    def _wand(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the threshold; passage ascends."""
        enough = threshold - 1e-9
        lists = self.b_offset[term + 1] - self.b_offset[term]
        order = np.lexsort((-lists, passage))
        term, lists = term[order], lists[order]
        begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        count = np.diff(np.append(begins, len(passage)))
        sums = np.cumsum(self.most[term])
        total = sums - np.repeat(sums[begins] - self.most[term[begins]], count)
        after = total >= enough  # the pivot and the lists behind it
        whose = np.repeat(np.arange(len(begins)), count)
        skipped = np.bincount(whose, ~after, minlength=len(begins)).astype(np.int64)
        slack = np.bincount(whose, np.where(after, 0.0, self.most[term]), minlength=len(begins))
        e, of = _ranges(self.b_offset[term[after]], lists[after])
        cells, where = np.unique(whose[after][of] * self.blocks + self.b_keys[e] % self.blocks, return_inverse=True)
        bound = np.bincount(where, self.b_most[e], minlength=len(cells))
        own = cells // self.blocks
        good = bound + slack[own] >= enough
        cells, bound, own = cells[good], bound[good], own[good]
        # The skipped lists' weights in the candidate blocks.
        at, of = _ranges(begins[own], skipped[own])
        key = term[at] * self.blocks + cells[of] % self.blocks
        place = np.minimum(np.searchsorted(self.b_keys, key), len(self.b_keys) - 1)
        bound += np.bincount(of, np.where(self.b_keys[place] == key, self.b_most[place], 0.0), minlength=len(cells))
        cells, own = cells[bound >= enough], own[bound >= enough]
        # Exact scores of the items of the blocks that are left.
        n = len(self.items)
        at, of = _ranges(begins[own], count[own])
        low = term[at] * n + cells[of] % self.blocks * BLOCK_ITEMS
        high = np.minimum(low + BLOCK_ITEMS, (term[at] + 1) * n)
        start = np.searchsorted(self.p_keys, low)
        e, posting = _ranges(start, np.searchsorted(self.p_keys, high) - start)
        found, where = np.unique(own[of[posting]] * n + self.p_keys[e] % n, return_inverse=True)
        score = np.bincount(where, self.p_weight[e], minlength=len(found))
        hit = score >= threshold
        return passage[begins[found[hit] // n]], found[hit] % n, score[hit]

    def matches(self, texts: list[bytes], threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) -> (score, question overlap, answer overlap) of its best verified passage."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        last, made = None, ([], {})
        for i, at, place, score in sorted(self.retrieve(texts, threshold)):
            if last != i:
                last, made = i, (texts[i].translate(_PLAIN).split(), {})
            words, grams = made
            if at not in grams:
                window = words[at : at + 2 * self.stride]
                grams[at] = {n: _grams(window, n) for n in (1, 2, 3)}
            share = [len(g & grams[at][len(next(iter(g)))]) / len(g) if g else 1.0 for g in self.parts[place]]
            if min(share) >= overlap:
                key = (i, self.items[place])
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *share))
        return best


def _item_ids(items: DataFrame, id_col: str) -> tuple[Column, DataType]:
    """The ids as they are returned: whole numbers as long, others as they are."""
    kind = items.schema[id_col].dataType
    return (F.col(id_col).cast("long"), LongType()) if isinstance(kind, IntegralType) else (F.col(id_col), kind)


def _classes(pairs: list[tuple[int, str]], statistics: Statistics | None) -> list[ItemIndex]:
    """An index for each class of lengths."""
    statistics = statistics or Statistics.of([t for _, t in pairs])
    classes: dict[int, list[tuple[int, str]]] = {}
    for i, t in pairs:
        classes.setdefault(_class(len(_words(t))), []).append((i, t))
    return [ItemIndex(x, statistics) for _, x in sorted(classes.items())]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, word) of the distinct words of each item, and one row (shard, null, length) for each item."""
    for b in batches:
        h, at = word_hashes([b" ".join(_words(t)) for t in b.column(1).to_pylist()])
        for i in range(b.num_rows):
            own = np.unique(h[at[i] : at[i + 1]]).view(np.int64)
            if len(own):
                words = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(own)])
                yield pa.record_batch([pa.array([b.column(0)[i].as_py()] * len(words), pa.int32()), words, pa.array([int(at[i + 1] - at[i])] + [0] * len(own), pa.int64())], ["shard", "word", "length"])


def _shards(items: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> Iterator[tuple[list[ItemIndex], list]]:
    """Indexes of the distinct pairs of id and text under numbers of their own, each with the ids of its numbers."""
    rows = items.select(_item_ids(items, id_col)[0].alias("id"), F.col(text_col).cast("string").alias("text")).where("length(trim(text)) > 0").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // shard_bytes))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    if n > 1:  # what is known of all items is counted once, and each shard gets that of its own words
        scratch = Scratch(items.sparkSession, "items")
        rows = scratch.write(rows, "items", partitionBy="shard")
        words = scratch.write(rows.select("shard", "text").mapInArrow(_hashes, "shard int, word long, length long"), "words")
        found_in = scratch.write(words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")), "frequencies")
        of_items = words.where("word is null")
        count, length = of_items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        lengths = [r.most for r in of_items.groupBy(F.length(F.bin(F.col("length") - 1))).agg(F.max("length").alias("most")).collect()]  # one for each power of two
    for s in range(n):
        pairs = [(r.id, r.text) for r in rows.where(F.col("shard") == s).orderBy("id", "text").collect()]
        statistics = None
        if n > 1:
            own = words.where((F.col("shard") == s) & F.col("word").isNotNull()).select("word").distinct().join(found_in, "word").toArrow()
            h, k = own.column("word").to_numpy().view(np.uint64), own.column("n").to_numpy()
            order = np.argsort(h)
            statistics = Statistics(count, length / max(count, 1), lengths, h[order], k[order])
        yield _classes(list(enumerate(text for _, text in pairs)), statistics), [i for i, _ in pairs]


def _matches(indexes: list[ItemIndex], texts: list[bytes], threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    return {k: v for index in indexes for k, v in index.matches(texts, threshold, overlap).items()}


def _binary(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shard_bytes: int = 16 << 20) -> DataFrame:
    """Columns id_col, item_col, score, question_overlap, answer_overlap: one row per row of docs and item (distinct pair of id and text) that it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = _item_ids(items, item_col)[1]
    item_name, item_arrow = item_kind.simpleString(), to_arrow_type(item_kind)

    def one(indexes: list[ItemIndex], ids: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((indexes, ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes, ids = shared.value
            for b in batches:
                found = sorted(_matches(indexes, _binary(b.column(1)), threshold, overlap).items())
                cols = list(zip(*((i, item, *v) for (i, item), v in found), strict=True)) or [[]] * 5
                yield pa.record_batch([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array([ids[x] for x in cols[1]], item_arrow), *(pa.array(c, pa.float64()) for c in cols[2:])], [id_col, item_col, "score", "question_overlap", "answer_overlap"])

        return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, `{item_col}` {item_name}, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, [one(*x) for x in _shards(items, id_col=item_col, text_col="text", shard_bytes=shard_bytes)])


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, text_col: str = "text", item_col: str = "item_id", shard_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for indexes, _ in _shards(items, item_col, "text", shard_bytes):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = {i for i, _ in _matches(shared.value, _binary(b.column(b.schema.get_field_index(text_col))), threshold, overlap)}
                yield b.take(pa.array([i for i in range(b.num_rows) if i not in hit], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
