"""Token ids in Simple-8b files: a corpus of documents encoded, written in id order and read back.

The file format is a folder of Parquet files whose rows are segments, written by Spark's own writer so that
it works on any store and survives lost or repeated tasks. A segment holds whole documents (about
65,536 ids, more only if one document has more): their ids and token counts, the segment's start within its
part, its dictionary (the distinct token ids, most frequent first), and the ranks in that dictionary, Simple-8b
coded in blocks of 8,192 with the word offset of each block, so that any block decodes alone and
vectorised. Parts are ranges of doc_id in ascending order; the ids before each part are sums over parts.

Encoding is that of the tokenizers library. Its pre-tokeniser never joins characters across white space, so
the ids of a text are those of its words; words are cached, and words of printable Latin-1 characters go straight to
the library's BPE model. Other words, and those with marks of special tokens, go through its whole pipeline.

Defined results: a null text is an empty document (the end id alone). Rows that repeat a doc_id are stored in
the order of their texts (equal rows in any order: they have the same ids); null doc_ids come first. An empty table is an empty folder. Texts of any
length are encoded whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches
from .simple8b import decode, encode

SEGMENT, BLOCK = 65_536, 8_192
#: Words cached in a worker (two generations of so many), and the longest that is.
CACHE, LONGEST = 250_000, 48
SCHEMA = "part int, seq int, start long, doc_ids array<long>, counts array<int>, dictionary binary, offsets binary, words binary"
_PLAIN = re.compile(r"[!-~¡-ÿ]+")
#: The pre-tokeniser's pattern for lower-case Latin-1 without white space.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")
_encoders: dict[str, WordEncoder] = {}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _model(self, pieces: list[str]) -> list[int]:
        return [t.id for piece in pieces for t in self.model.tokenize(piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()]))]

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        if low.isascii() and low.isalpha():
            ids = self._model([low])
        elif _PLAIN.fullmatch(text) and "<|" not in text:
            ids = self._model(_PIECES.findall(low))
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        words = (text or "").encode("utf-8", "replace").split()
        found = list(map(self.young.get, words))
        if None in found:
            if len(self.young) > CACHE:
                self.old, self.young = self.young, {}
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    x = self.young.get(w) or self.old.get(w)
                    if x is None:
                        x = self._word(w)
                    if len(w) <= LONGEST:
                        self.young[w] = x
                    found[i] = x
        return b"".join(found)


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Dictionary, block offsets and words of a segment's ids."""
    # Token ids are below a vocabulary's size, so they are counted in a table.
    n = np.bincount(ids)
    distinct = np.flatnonzero(n)
    distinct = distinct[np.argsort(-n[distinct], kind="stable")]
    rank = np.zeros(len(n), np.uint64)
    rank[distinct] = np.arange(len(distinct), dtype=np.uint64)
    codes = rank[ids]
    blocks = [encode(codes[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0] + [len(b) for b in blocks], dtype=np.uint32)
    return distinct.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), np.concatenate(blocks).astype("<u8").tobytes()


def unpack(dictionary: bytes, offsets: bytes, words: bytes, count: int) -> np.ndarray:
    d, o, w = np.frombuffer(dictionary, "<u4"), np.frombuffer(offsets, "<u4"), np.frombuffer(words, "<u8")
    parts = [decode(w[o[i] : o[i + 1]], min(BLOCK, count - i * BLOCK)) for i in range(len(o) - 1)]
    return d[np.concatenate([np.empty(0, np.uint64), *parts]).astype(np.int64)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the segments, in ascending id order, to a new folder."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], np.uint32).tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = pyspark.TaskContext.get().partitionId(), encoder(tokenizer)
        seq, start, ids, held, size = 0, 0, [], [], 0

        def made() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), "<u4")
            cols = [[part], [seq], [start], [ids], [[len(x) // 4 for x in held]], *([x] for x in pack(tokens))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "seq", "start", "doc_ids", "counts", "dictionary", "offsets", "words"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = enc.ids(text.as_py()) + end
                ids.append(i), held.append(tokens)
                size += len(tokens) // 4
                if size >= SEGMENT:
                    yield made()
                    seq, start, ids, held, size = seq + 1, start + size, [], [], 0
        if ids:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Dealt by range before the texts are encoded: the range is sampled from the scan, and nothing is encoded twice.
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(segments, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 and, if asked for, ids: decoded from the files alone."""
    bounded_batches(spark)
    stored = spark.read.schema(SCHEMA).parquet(path)
    # One row for each part: as many as the tasks that wrote.
    sizes = stored.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, total = {}, 0
    for part, n in sorted(sizes):
        base[part], total = total, total + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part, start, doc_ids, counts, *packed = (b.column(c)[r].as_py() for c in ("part", "start", "doc_ids", "counts", "dictionary", "offsets", "words"))
                ends = np.cumsum(counts, dtype=np.int64)
                ids = unpack(*packed, int(ends[-1]))
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts, strict=True)]
                out = [pa.array(doc_ids, pa.int64()), pa.array(base[part] + start + ends - counts), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.uint32()).cast(pa.int64())))
                yield pa.record_batch(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return stored.select("part", "start", "doc_ids", "counts", "dictionary", "offsets", "words").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    spark = docs.sparkSession
    path = Scratch(spark, "tokens").root
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
