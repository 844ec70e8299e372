"""SentencePiece segmentations sampled without replacement: Gumbel top-k by perturbed A-star search.

A text's lattice has an edge for each piece of the vocabulary at each place (and the piece's bytes for a
character that has none); no piece crosses from a character to a following blank, so the lattice is a chain of
short ones, one for each word. With log-weight -theta * ln(rank + 2) for the piece of merge rank `rank`, backward
sums give each edge its exact conditional probability. The search tree fixes one edge after the other: a node's
Gumbel-perturbed log-probability is the largest in its subtree, its best child inherits it, the others get
Gumbels truncated below it, and the agenda's largest node is expanded next. The k segmentations popped first are a
sample without replacement (the top k of all perturbed log-probabilities). With kappa the perturbed value of the
next node, a segmentation of log-probability p was included with probability 1 - exp(-exp(p - kappa)).

Noise is a hash of the row's key, the sample's number, the place and the edge, so a row's samples do not depend
on how rows are batched or dealt. A task keeps the lattices of its words (`Lattices`)
for the texts to come, within a bound, so a word that comes again costs its walk alone.

Decoding joins the pieces, bytes as UTF-8, blanks for their marks, without the first. Defined results: a null or empty text has one
segmentation, without pieces, of probability one. Texts with fewer segmentations than k give those they have,
each with inclusion 1. Rows that repeat a key get the same samples. Edges of equal noise are taken in the order of their lengths. Texts of any length are
segmented whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .hashing import mixed

MARK = "▁"
#: Ids from here stand for a character without a piece, until they become bytes.
RAW = 1 << 24
_CHUNKS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Vocabulary:
    """Pieces as a double-array trie, with log-weights; a few MB, built once on the driver."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        # What each id stands for in a text, as bytes.
        self.raw = np.array([None, *(p.replace(MARK, " ").encode() for p in self.pieces)], object)[1:]
        self.byte_ids = np.zeros(256, np.int64)
        for b, i in self.bytes.items():
            self.raw[i], self.byte_ids[b] = bytes([b]), i
        assert not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) or "\n" in self.pieces[i] for i in plain), "a piece crosses words"
        self.weight = np.full(size, -theta * np.log(size + 2.0))
        for i in plain:
            self.weight[i] = -theta * np.log(2.0 - sp.get_score(i))
        self.raw_weight = -theta * np.log(size + 2.0)
        singles = {ord(self.pieces[i]): i for i in plain if len(self.pieces[i]) == 1}
        self.single = np.full(max(singles, default=0) + 2, -1, np.int32)
        self.single[list(singles)] = list(singles.values())
        longer = [i for i in plain if len(self.pieces[i]) > 1]
        letters = sorted({c for i in longer for c in self.pieces[i]})
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i in longer:
            at = 0
            for c in self.pieces[i]:
                k = int(self.letter[ord(c)])
                if k not in nodes[at]:
                    nodes[at][k] = len(nodes)
                    nodes.append({})
                at = nodes[at][k]
            ends[at] = i
        # Nodes with the most children first; each goes to the first base where all its children's slots are free.
        used = np.zeros(len(nodes) * 2 + 4 * len(letters) + 4096, bool)
        used[: len(letters) + 2] = True  # so that no base is negative
        base, place, parent = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        start: dict[int, int] = {}  # by number of children: below it no slot was free for the first child
        for n in sorted(range(len(nodes)), key=lambda n: -len(nodes[n])):
            if not nodes[n]:
                continue
            keys = np.array(sorted(nodes[n]))
            at = start.get(len(keys), len(letters) + 2)
            while True:
                window = np.arange(at, min(at + 512, len(used) - len(letters) - 2))
                bases = window[~used[window]] - keys[0]
                fits = ~used[bases[:, None] + keys].any(axis=1)
                if fits.any():
                    break
                at += 512
            start[len(keys)] = at
            base[n] = bases[fits.argmax()]
            used[base[n] + keys] = True
            for k, child in nodes[n].items():
                place[child], parent[child] = base[n] + k, n
        slots = len(used) + len(letters) + 2
        self.base, self.check, self.ends = np.zeros(slots, np.int32), np.full(slots, -1, np.int32), np.full(slots, -1, np.int32)
        self.base[place] = base
        self.check[place[1:]] = place[parent[1:]]
        for n, i in ends.items():
            self.ends[place[n]] = i

    def lattice(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges by place: offset of each place's edges (one more than places), their lengths and ids. Code 0 ends a word."""
        letter = self.letter[np.minimum(code, len(self.letter) - 1)]
        single = self.single[np.minimum(code, len(self.single) - 1)].astype(np.int64)
        single = np.where(single >= 0, single, RAW + code)
        real = np.flatnonzero(code > 0)
        found = [(real, single[real])]
        count = (code > 0).astype(np.int64)
        p, state, length = real[letter[real] > 0], 0, 0
        state = np.zeros(len(p), np.int64)
        while len(p):
            c = letter[p + length]
            to = self.base[state] + c
            good = (c > 0) & (self.check[to] == state)
            p, state = p[good], to[good].astype(np.int64)
            length += 1
            if length > 1:
                hit = self.ends[state] >= 0
                found.append((p[hit], self.ends[state[hit]].astype(np.int64)))
                count[p[hit]] += 1
        offset = np.concatenate([[0], np.cumsum(count)])
        lengths, ids, fill = np.empty(offset[-1], np.int32), np.empty(offset[-1], np.int64), offset[:-1].copy()
        for n, (p, i) in enumerate(found):
            lengths[fill[p]], ids[fill[p]] = n + 1, i
            fill[p] += 1
        return offset, lengths, ids


def _words(text: str) -> list[str]:
    """Words of a text, each with the blanks before it as marks; line ends are words of their own."""
    if MARK in text or "\0" in text or "  " in text or text[:1] == " ":
        return _CHUNKS.findall(MARK + text.replace(" ", MARK))
    # Of such a text no word begins with two marks, so cuts before blanks and around line ends are all there are.
    return list(filter(None, (MARK + text.replace("\n", "\0\n\0").replace(" ", "\0" + MARK)).split("\0")))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, `size` numbers for each range, one range after the other."""
    out = np.repeat(begin - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mixed(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(key: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(key)))


class Lattices:
    """Lattices of words, one after the other, kept for the texts to come: a word that comes again is not taken apart again.

    Once there are more than `most` places, words that came once go, and of the others those that came most stay, in half of it.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 1 << 19):
        self.v, self.most = vocabulary, most
        self.words: defaultdict[str, int] = defaultdict(count().__next__)
        # By word: its first place, its end and how often it came; by place (and one more): where its edges begin; by edge the rest.
        self.first, self.end, self.uses = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.offset = np.zeros(1, np.int64)
        self.id, self.length, self.logp, self.mean, self.salt = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, np.uint64)
        self.known = self.places = self.edges = 0

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' words, and where each text's words begin (one more entry than texts)."""
        if self.places > self.most:
            self._shrink()
        number, starts = [], [0]
        for t in texts:
            number += map(self.words.__getitem__, _words(t) if t else [])
            starts.append(len(number))
        if len(self.words) > self.known:
            self._add([*islice(reversed(self.words), len(self.words) - self.known)][::-1])
        out = np.array(number, np.int64)
        self.uses[: self.known] += np.bincount(out, minlength=self.known)
        return out, np.array(starts, np.int64)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if at + len(values) > len(old):
            setattr(self, name, np.empty(max(at + len(values), 2 * len(old)), old.dtype))
            getattr(self, name)[:at] = old[:at]
        getattr(self, name)[at : at + len(values)] = values

    def _add(self, words: list[str]) -> None:
        v = self.v
        # A NUL in a text ends no word: it is a character without a piece.
        code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1
        stop = np.zeros(len(code), bool)
        stop[first + size] = True
        code = np.where(stop, 0, np.where(code == 0, 0x10FFFF + 1, code))
        offset, length, ids = v.lattice(code)
        raw = ids >= RAW
        weight = v.weight[np.where(raw, 0, ids)]
        if raw.any():
            c = ids[raw] - RAW
            weight[raw] = v.raw_weight * (1 + (c > 0x7F) + (c > 0x7FF) + ((c > 0xFFFF) & (c <= 0x10FFFF)))
        degree = np.diff(offset)
        place = np.repeat(np.arange(len(code)), degree)
        left = np.repeat(first + size, size + 1) - np.arange(len(code))
        # Places and edges by what is left of their words, so that each step of the sums reads slices.
        small = left.astype(np.uint16) if left.max() < 65536 else left
        order, edges = np.argsort(small, kind="stable"), np.argsort(small[place], kind="stable")
        n = degree[order]
        begin = np.cumsum(n) - n
        upto, to, heavy = np.cumsum(np.bincount(left)), (place + length)[edges], weight[edges]
        edge_upto = np.append(begin, len(edges))[upto]
        backward = np.zeros(len(code))
        for d in range(1, len(upto)):
            own, mine = slice(upto[d - 1], upto[d]), slice(edge_upto[d - 1], edge_upto[d])
            x = heavy[mine] + backward[to[mine]]
            starts = begin[own] - mine.start
            top = np.maximum.reduceat(x, starts)
            x -= np.repeat(top, n[own])
            backward[order[own]] = top + np.log(np.add.reduceat(np.exp(x, out=x), starts))
        logp = weight + backward[place + length] - backward[place]
        inside = np.arange(len(code)) - np.repeat(first, size + 1)
        self._put("first", self.known, self.places + first)
        self._put("end", self.known, self.places + first + size)
        self._put("uses", self.known, np.zeros(len(words), np.int64))
        self._put("offset", self.places + 1, self.edges + offset[1:])
        self._put("id", self.edges, ids)
        self._put("length", self.edges, length)
        self._put("logp", self.edges, logp)
        self._put("mean", self.edges, np.exp(np.minimum(-logp, 690.0)))
        with np.errstate(over="ignore"):
            self._put("salt", self.edges, (inside.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))[place] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.known, self.places, self.edges = self.known + len(words), self.places + len(code), self.edges + len(ids)

    def _shrink(self) -> None:
        size = self.end[: self.known] - self.first[: self.known] + 1
        most_used = np.argsort(-self.uses[: self.known], kind="stable")
        keep = np.sort(most_used[(np.cumsum(size[most_used]) <= self.most // 2) & (self.uses[most_used] > 1)])
        names = [*self.words]
        self.words = defaultdict(count(len(keep)).__next__, {names[w]: i for i, w in enumerate(keep.tolist())})
        first, size = self.first[keep], size[keep]
        at, edges = _ranges(first, size), _ranges(self.offset[first], self.offset[first + size] - self.offset[first])
        degree = self.offset[at + 1] - self.offset[at]
        self.first = np.cumsum(size) - size
        self.end, self.uses = self.first + size - 1, np.zeros(len(keep), np.int64)
        self.offset = np.concatenate([[0], np.cumsum(degree)])
        for name in ("id", "length", "logp", "mean", "salt"):
            setattr(self, name, getattr(self, name)[edges])
        self.known, self.places, self.edges = len(keep), len(at), len(edges)


class Sampler:
    """Samples for a group of texts, whose words may be known from earlier groups."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str | None], lattices: Lattices | None = None):
        known = lattices or Lattices(vocabulary)
        self.number, self.starts = known.numbers(texts)
        self.first, self.end, self.offset = known.first, known.end, known.offset[: known.places + 1]
        self.id, self.length, self.logp, self.mean, self.salt = known.id, known.length, known.logp, known.mean, known.salt

    def walk(self, word: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follow the best child from each (word instance, place) to the word's end.

        Edges race: of exponential times with the edges' probabilities as rates, the least belongs to the edge of the largest
        Gumbel-perturbed log-probability. Returns the edges taken, word instance by word instance, the instance of each, and by how much
        its time is less than the next edge's (infinity where there is none).
        """
        seen, steps = [], 0
        end = self.end[self.number[word]]
        live = np.flatnonzero(at < end)
        here, own, end = at[live], key[live], end[live]

        def times(edge: np.ndarray, own: np.ndarray) -> np.ndarray:
            out = np.log(_uniform(own + self.salt[edge]))
            out *= self.mean[edge]
            return np.negative(out, out=out)

        while len(live):
            # Places with more edges first, so that those with a second, third edge and so on are slices.
            begin = self.offset[here]
            n = self.offset[here + 1] - begin
            order = np.argsort(-n.astype(np.int16), kind="stable")
            live, own, end, here, taken = live[order], own[order], end[order], here[order], begin[order]
            having = len(n) - np.cumsum(np.bincount(n))
            begin, lead = taken.copy(), np.full(len(n), np.inf)
            m = int(having[1]) if len(having) > 1 else 0
            with np.errstate(over="ignore"):
                least, second = times(begin[:m], own[:m]), lead[:m]
                for j in range(1, len(having) - 1):
                    m = int(having[j])
                    edge = begin[:m] + j
                    t = times(edge, own[:m])
                    np.copyto(taken[:m], edge, where=t < least[:m])  # equal noise: the first of the edges
                    np.minimum(second[:m], np.maximum(t, least[:m]), out=second[:m])
                    np.minimum(least[:m], t, out=least[:m])
            second -= least
            seen.append((live, np.full(len(live), steps), taken, lead))
            here += self.length[taken]
            go = np.flatnonzero(here < end)
            live, here, own, end = live[go], here[go], own[go], end[go]
            steps += 1
        if not seen:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        inst, step, edge, lead = (np.concatenate(x) for x in zip(*seen, strict=True))
        n = np.bincount(inst, minlength=len(word))
        to = (np.cumsum(n) - n)[inst] + step
        path, ahead = np.empty(len(edge), np.int64), np.empty(len(edge))
        path[to], ahead[to] = edge, lead
        return path, np.repeat(np.arange(len(word)), n), ahead

    def place(self, edge: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offset, edge, side="right") - 1

    def sample(self, seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples in order: ids (RAW ones included), log-probability, perturbed value, inclusion."""
        docs = len(self.starts) - 1
        root = _gumbel(seeds)
        out: list[list] = [[] for _ in range(docs)]
        agenda: list[list] = [[] for _ in range(docs)]  # (perturbed value, parent's path, step in it, edge, word instance)
        todo = [(d, np.empty(0, np.int64), int(self.starts[d]), -1, float(root[d])) for d in range(docs)]
        for s in range(k):
            if not todo:
                break
            doc, since, last, bound = (np.array([t[i] for t in todo]) for i in (0, 2, 3, 4))
            spans = self.starts[doc + 1] - since
            begin = np.cumsum(spans) - spans
            word = _ranges(since, spans)
            at = self.first[self.number[word]]
            inner = last >= 0
            at[begin[inner]] = self.place(last[inner]) + self.length[last[inner]]
            with np.errstate(over="ignore"):
                key = mixed(np.repeat(seeds[doc] + np.uint64(s + 1) * np.uint64(0xD6E8FEB86659FD93), spans) + (word - np.repeat(self.starts[doc], spans) + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            path, inst, lead = self.walk(word, at, key)
            bounds = np.searchsorted(inst, np.concatenate([begin, [len(word)]]))
            # Log-probability of each step's open nodes: of the prefix and of the steps before it.
            sums = np.concatenate([[0.0], np.cumsum(self.logp[path])])
            ahead = np.array([self.logp[t[1]].sum() for t in todo]) - sums[bounds[:-1]]
            # The smaller log(lead) - phi, the larger the best of a step's open nodes. At most k - s nodes of this path can be popped or be the
            # threshold, and they lie in the k - s best steps.
            with np.errstate(divide="ignore"):
                rank = np.log(lead) - sums[:-1]
            best = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                mine = rank[a:b]
                if b - a <= k - s:
                    best.append(np.arange(a, b))
                else:
                    best.append(a + (np.argpartition(mine, k - s - 1)[: k - s] if k - s > 1 else np.array([mine.argmin()])))
            step = np.concatenate(best)
            whose, from_ = np.repeat(np.arange(len(todo)), [len(x) for x in best]), self.place(path[step])
            edges = self.offset[from_ + 1] - self.offset[from_]
            o_edge, whose, step = _ranges(self.offset[from_], edges), np.repeat(whose, edges), np.repeat(step, edges)
            with np.errstate(over="ignore"):
                x = self.logp[o_edge] + _gumbel(key[inst[step]] + self.salt[o_edge])
                top = self.logp[path[step]] + _gumbel(key[inst[step]] + self.salt[path[step]])
            phi = sums[step] + ahead[whose]
            over = bound[whose] - phi
            y = over - x + np.log(np.maximum(-np.expm1(x - top), 1e-300))
            value = phi + over - np.maximum(y, 0) - np.log1p(np.exp(-np.abs(y)))
            is_open = o_edge != path[step]
            following = []
            for i, (d, prefix, _inst, _edge, own) in enumerate(todo):
                whole = np.concatenate([prefix, path[bounds[i] : bounds[i + 1]]])
                out[d].append((whole, own))
                mine = np.flatnonzero(is_open & (whose == i))
                mine = mine[np.argsort(-value[mine], kind="stable")[: k - s]]
                agenda[d] += [(float(value[j]), whole, len(prefix) + int(step[j] - bounds[i]), int(o_edge[j]), int(word[inst[step[j]]])) for j in mine]
                agenda[d].sort(key=lambda a: -a[0])
                if s + 1 < k and agenda[d]:
                    best_value, parent, at_step, edge, instance = agenda[d].pop(0)
                    following.append((d, np.concatenate([parent[:at_step], [edge]]), instance, edge, best_value))
            todo = following
        made = []
        for d in range(docs):
            kappa = agenda[d][0][0] if agenda[d] else -np.inf
            made.append([(self.id[p], lp := float(self.logp[p].sum()), g, float(-np.expm1(-np.exp(min(lp - kappa, 700.0))))) for p, g in out[d]])
        return made


def ids_of(raws: list[np.ndarray], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Piece ids of each sample, with the bytes of characters that have no piece."""
    raw = np.concatenate(raws)
    ends = np.cumsum([len(r) for r in raws])
    bare = raw >= RAW
    c = raw[bare] - RAW
    c = np.where(c > 0x10FFFF, 0, np.where((c >= 0xD800) & (c < 0xE000), ord("?"), c))
    size = np.ones(len(raw), np.int64)
    size[bare] += (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    out = np.repeat(raw, size)
    out[np.repeat(bare, size)] = vocabulary.byte_ids[np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
    return np.split(out.astype("<i4"), np.concatenate([[0], np.cumsum(size)])[ends[:-1]])


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """Text of piece ids: bytes are put together, marks become blanks, the first blank goes."""
    return b"".join(vocabulary.raw[ids].tolist()).decode("utf-8", "replace")[1:]


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, theta: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = 96) -> DataFrame:
    """Columns id_col, sample (from 0), ids (little-endian 32-bit, binary), log_prob, perturbed, inclusion, decoded_ok.

    One row for each sample of each input row; decoded_ok says that decoding the ids gives the text again
    (a mark in the text itself comes back as a blank, and a lone surrogate as a replacement character).
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model, theta))  # the vocabulary's size is fixed
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        lattices = Lattices(v)
        for b in batches:
            for at in range(0, b.num_rows, group):
                keys, texts = b.column(0).slice(at, group), b.column(1).slice(at, group).to_pylist()
                with np.errstate(over="ignore"):
                    seeds = mixed(np.array([xxhash.xxh64_intdigest(str(x), seed) for x in keys.to_pylist()], np.uint64))
                made = Sampler(v, texts, lattices).sample(seeds, k)
                ids = iter(ids_of([raw for samples in made for raw, *_ in samples], v))
                rows = [(i, n, next(ids), lp, g, q) for i, samples in enumerate(made) for n, (_, lp, g, q) in enumerate(samples)]
                good = [decode_ids(x, v) == (texts[i] or "").replace(MARK, " ") for i, _, x, *_ in rows]
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([keys.take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array([x.tobytes() for x in cols[2]], pa.binary()), *(pa.array(c, pa.float64()) for c in cols[3:]), pa.array(good)], [id_col, "sample", "ids", "log_prob", "perturbed", "inclusion", "decoded_ok"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, sample int, ids binary, log_prob double, perturbed double, inclusion double, decoded_ok boolean")
