"""Simple-8b: many small integers in each 64-bit word, vectorised both ways.

The top four bits of a word select how its 60 payload bits are used: (integers, bits each) as in SLOTS. Selectors
0 and 1 are runs of zeros; selector 15 is the escape, whose value is the whole next word (for 60 bits and more).
The last word of a block may hold fewer integers than it has room for; the block's count says so.
"""

from __future__ import annotations

import numpy as np

#: Selector -> (integers in a word, bits of each); 15 is the escape.
SLOTS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
_COUNTS = np.array([n for n, _ in SLOTS] + [1])


def encode(values: np.ndarray) -> np.ndarray:
    """Words of one block; values are unsigned 64-bit integers."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.empty(0, np.uint64)
    padded = np.concatenate([v, np.zeros(240, np.uint64)])
    small = padded.astype(np.uint32) if v.max() < 1 << 30 else None
    choice = np.full(n, ESCAPE, np.int8)
    # From the widest slots that some value needs to the narrowest: the last that fits holds the most integers.
    most = int(v.max()).bit_length()
    enough = next((s for s, (_, bits) in enumerate(SLOTS) if bits >= most), len(SLOTS) - 1)
    over = np.zeros(n + 241, np.int32)
    for s in range(enough, -1, -1):
        count, bits = SLOTS[s]
        if bits >= most:
            choice[:] = s
            continue
        np.cumsum(small > (1 << bits) - 1 if small is not None else padded >> np.uint64(bits) != 0, dtype=np.int32, out=over[1:])
        # A run that reaches past the end is padding; it may only be chosen as the last word, where it costs nothing.
        choice[over[count : count + n] == over[:n]] = s
    step = _COUNTS[choice].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    chosen = choice[at]
    place = np.cumsum(np.where(chosen == ESCAPE, 2, 1))
    out = np.zeros(place[-1], np.uint64)
    place = place - np.where(chosen == ESCAPE, 2, 1)
    for s in np.unique(chosen):
        where, head = chosen == s, np.uint64(int(s) << 60)
        if s == ESCAPE:
            out[place[where]], out[place[where] + 1] = head, padded[at[where]]
            continue
        count, bits = SLOTS[s]
        word = np.full(where.sum(), head)
        if bits:
            part = padded[at[where][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            word |= np.bitwise_or.reduce(part, axis=1)
        out[place[where]] = word
    return out


def decode(words: np.ndarray, count: int) -> np.ndarray:
    """The first count integers of a block's words."""
    w = np.asarray(words, np.uint64)
    if not count:
        return np.empty(0, np.uint64)
    chosen = (w >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(w), bool)
    for i in np.flatnonzero(chosen == ESCAPE):  # the word after an escape is a value, not a selector
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    chosen = chosen[heads]
    ends = np.cumsum(_COUNTS[chosen])
    out = np.zeros(ends[-1], np.uint64)
    for s in np.unique(chosen):
        where = chosen == s
        start = ends[where] - _COUNTS[s]
        if s == ESCAPE:
            out[start] = w[heads[where] + 1]
        elif SLOTS[s][1]:
            size, bits = SLOTS[s]
            part = w[heads[where]][:, None] >> (np.arange(size, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
            out[start[:, None] + np.arange(size)] = part
    return out[:count]
