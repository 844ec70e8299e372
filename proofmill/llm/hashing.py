"""Vectorised 64-bit hashes of words, many texts at a time."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; longer texts are cut at white space.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def power(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2 ** 64."""
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        with np.errstate(over="ignore"):
            got = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BLOCK + 4096) - 1, base)]), dtype=np.uint64)
        if n <= 4 * BLOCK:
            _powers[str(base)] = got
    return got[:n]


def _words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of buf; A-Z count as a-z, words end at ASCII white space."""
    raw = np.frombuffer(buf, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * power(BASE, len(raw)), dtype=np.uint64)])
        h = (sums[end] - sums[start]) * power(INVERSE, len(raw) + 1)[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (one more entry than texts)."""
    out, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            h, at = _words(b"\n".join(group))
            bounds = np.cumsum([0] + [len(t) + 1 for t in group])
            counts.extend(np.diff(np.searchsorted(at, bounds)))
            out.append(h)
            group, size = [], 0

    for t in texts:
        if len(t) > BLOCK:
            flush()
            n, at = 0, 0
            while at < len(t):
                cut = at + BLOCK
                while cut < len(t) and not _SPACE[t[cut]]:
                    cut += 1
                h, _ = _words(t[at:cut])
                out.append(h)
                n, at = n + len(h), cut
            counts.append(n)
            continue
        if size + len(t) > BLOCK:
            flush()
        group.append(t)
        size += len(t) + 1
    flush()
    return np.concatenate([np.empty(0, np.uint64), *out]), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; of the whole sequence where there are fewer."""
    k = min(k, len(h))
    if not k:
        return h
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, 0x51ED270B + k, np.uint64)
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out
