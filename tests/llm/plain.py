"""Plain versions of the operators: loops over words and dictionaries, nothing of the library's code but its fixed values and trained weights."""

from __future__ import annotations

import math
import re
from collections import Counter

from proofmill.llm import license_scan, pii

WORD64 = (1 << 64) - 1


# ---------------------------------------------------------------- quality
def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD64
    return x ^ x >> 31


def word_number(w):
    out, factor = 0, 1
    for c in w:
        out, factor = out + (ord(c) + 1) * factor & WORD64, factor * 0x9E3779B97F4A7C15 & WORD64
    return mix(out)


def kind(c):
    return 0 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:?'\"()-" else 5


def passages(text):
    """Features of each run of 64 words."""
    words, lines, at = [], [], 0
    for c, run in re.findall(r"(\s+)|(\S+)", text or ""):
        if run:
            words.append(run), lines.append(at > 0)
            at = 0
        else:
            at += c.count("\n")
    if not words:
        return [[0.0] * 85]
    numbers = [word_number(w) for w in words]
    pairs = [mix(n * 3 + numbers[(i + 1) % len(numbers)] & WORD64) for i, n in enumerate(numbers)]
    often, out = Counter(pairs), []
    for a in range(0, len(words), 64):
        own, size = range(a, min(a + 64, len(words))), min(64, len(words) - a)
        kinds = [Counter(map(kind, words[i])) for i in own]
        chars = sum(len(words[i]) for i in own)
        mean = lambda f: sum(map(f, range(size))) / size
        letters = sum(k[1] + k[2] for k in kinds)
        row = [
            chars / size / 6, sum(len(words[i]) ** 2 for i in own) / size / 60, sum(k[2] for k in kinds) / max(letters, 1), *(sum(k[x] for k in kinds) / chars for x in (3, 4, 5)),
            mean(lambda i: kinds[i][2] == len(words[a + i]) > 1), mean(lambda i: kinds[i][2] > 1 and not kinds[i][1]), mean(lambda i: not kinds[i][1] + kinds[i][2]), mean(lambda i: kinds[i][5] > 0),
            mean(lambda i: kind(words[a + i][-1]) == 5), mean(lambda i: kind(words[a + i][-1]) == 4), mean(lambda i: kind(words[a + i][0]) == 2), mean(lambda i: words[a + i][-1] in ".?!"), mean(lambda i: words[a + i][-1] == "!"),
            mean(lambda i: lines[a + i]), mean(lambda i: a + i > 0 and words[a + i] == words[a + i - 1]), len({words[i] for i in own}) / size, len({pairs[i] for i in own}) / size, mean(lambda i: often[pairs[a + i]] > 1), mean(lambda i: len(words[a + i]) <= 3),
        ]
        # Bits of each byte of the number from the highest, bytes from the lowest.
        bits = [[1 if numbers[i] >> 8 * (b // 8) + 7 - b % 8 & 1 else -1 for b in range(64)] for i in own]
        out.append(row + [sum(x[b] for x in bits) / math.sqrt(size) / 4 for b in range(64)])
    return out


def quality(model, text):
    """Gated attention over the passages, with the trained weights."""
    p, hidden, energy = model.p, [], []
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-40, min(40, x))))
    dot = lambda v, w, j: sum(v[i] * w[i][j] for i in range(len(v)))
    for row in passages(text):
        x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        h = [math.tanh(dot(x, p["W"], j) + p["b"][j]) for j in range(len(p["b"]))]
        hidden.append(h)
        energy.append(sum(math.tanh(dot(h, p["V"], j)) * sigmoid(dot(h, p["U"], j)) * p["w"][j] for j in range(len(p["w"]))))
    weight = [math.exp(e - max(energy)) for e in energy]
    z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(p["b"]))]
    return sigmoid(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"][0])


# ---------------------------------------------------------------- personal data
def luhn(d):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    """(start, kind, end) by the contract's own patterns."""
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(n(m)) <= 19 and luhn(n(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(n(m)) <= 15])


def all_spans(texts, rounds=2, accept=0.9, support=4, digits=7):
    """Spans of each text: the base ones, and those of the bootstrap over all of them."""
    base, tokens = [base_spans(t) for t in texts], []
    words = lambda x: re.findall(r"[^ \t\n\x0b\f\r]+", x)
    for d, t in enumerate(texts):
        found = list(re.finditer(pii.TOKEN, t, re.ASCII))
        for i, m in enumerate(found):
            before, after = words(t[found[i - 1].end() if i else 0 : m.start()]), words(t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)])
            seed = any(a < m.end() and b > m.start() for a, _, b in base[d])
            around = [" ".join(before[-2:]).lower(), f"{' '.join(before[-1:]).lower()} _ {(after or [''])[0].lower()}"]
            tokens.append((d, m.start(), m.end(), m[0].lower(), seed, ["b" + around[0], "a" + around[1]]))
    by_pattern, by_instance, fixed = {}, {}, set()
    for *_, x, seed, patterns in tokens:
        fixed |= {x} if seed else set()
        for p in patterns:
            by_pattern.setdefault(p, set()).add(x)
            by_instance.setdefault(x, set()).add(p)
    letters, numbers = lambda x: sum(c.isalpha() for c in x), lambda x: sum(c in "0123456789" for c in x)
    long = lambda x: numbers(x) >= max(digits, letters(x))
    score, before, done = {x: float(x in fixed) for x in by_instance}, 0, 0
    while True:
        sure = {p: min(sum(score[x] for x in own) / (len(own) + 1 / support), 0.999) for p, own in by_pattern.items() if len(own) >= support}
        score = {}
        for x, own in by_instance.items():
            said = [sure[p] for p in own if p in sure]
            miss = lambda cs: 1 - math.exp(sum(math.log1p(-c) for c in cs))
            strong = [c for c in said if c >= 0.5]
            score[x] = 1.0 if x in fixed else miss(said) if long(x) else miss(strong) if 2 * len(strong) >= len(said) else 0.0
        accepted, done = sum(s >= accept for x, s in score.items() if x not in fixed), done + 1
        if done >= rounds and accepted <= before:
            break
        before = accepted
    new = {x for x, s in score.items() if s >= accept and x not in fixed and (long(x) or letters(x) or "@" in x)}
    for d, a, b, x, seed, patterns in tokens:
        said = 1 - math.exp(sum(math.log1p(-sure[p]) for p in set(patterns) if sure.get(p, 0) >= 0.5))
        if not seed and (x in new or said >= accept):
            base[d].append((a, 4, b))
    return [sorted(s) for s in base]


def masked(text, spans):
    at, parts = 0, []
    for a, k, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


# ---------------------------------------------------------------- benchmark
def item_words(text):
    return "".join(" " if c.isascii() and c.isprintable() and not c.isalnum() else c.lower() if c.isascii() else c for c in text).split()


def retrieval(items, texts, threshold):
    """BM25 over each item's own score, for every passage and item, word by word."""
    words = {i: item_words(t) for i, t in items if item_words(t)}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for x in words.values() for w in set(x))
    weight = {i: {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, c in Counter(x).items()} for i, x in words.items()}
    stride, out = max(32, *map(len, words.values())), {}
    for d, t in enumerate(texts):
        x = item_words(t)
        for at in range(0, len(x) + 1, stride):
            have = set(x[at : at + 2 * stride])
            for i, own in weight.items():
                share = sum(v for w, v in own.items() if w in have) / sum(own.values())
                if share >= threshold:
                    out[d, at, i] = share
    return out


def contaminated(items, texts, threshold=0.6, overlap=0.5):
    """Indices of the texts with a passage that holds an item: retrieved, and with half of the question's and of the answer's n-grams."""
    grams = lambda w, n: set(zip(*(w[i:] for i in range(min(n, len(w)))), strict=False)) if w else set()
    text_of, out = dict(items), set()
    stride = max(32, *(len(item_words(t)) for _, t in items))
    for d, at, i in retrieval(items, texts, threshold):
        parts = [p for p in re.split(r"(?<=[.!?])\s+", text_of[i].strip()) if p]
        if len(parts) > 1:
            halves = item_words(" ".join(parts[:-1])), item_words(parts[-1])
        else:
            w = item_words(text_of[i])
            cut = max(1, len(w) - max(1, len(w) // 3))
            halves = w[:cut], w[cut:]
        window = item_words(texts[d])[at : at + 2 * stride]
        shares = [len(g & grams(window, min(n, len(h)))) / len(g) if (g := grams(h, n)) else 1 for h, n in zip(halves, (3, 2), strict=True)]
        if min(shares) >= overlap:
            out.add(d)
    return out


# ---------------------------------------------------------------- near-duplicates
def components(texts, k, percent):
    """Smallest id that each reaches by links between its own and others' whole shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^ \t\n\x0b\f\r]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


# ---------------------------------------------------------------- licences
def licences(model, text, confirm):
    """Confirmed windows of the lines and of the paragraphs of several lines."""
    plain = lambda x: license_scan._plain(x).split()
    lines = [plain(x) for x in text.split("\n")]

    def windows(words, at):
        n, half = len(words), license_scan.HALF
        for w in range(max(1, -(-n // half) - 1)):
            part = words[w * half : (w + 2) * half]
            x = model.rows([b" ".join(part)])[0]
            if not x.any():
                continue
            z = [(float(x @ model.weight[:, f]) + float(model.bias[f])) / model.temperature for f in range(len(model.families))]
            e = [math.exp(v - max(z)) for v in z]
            f = max(range(1, len(e)), key=lambda i: e[i])
            if e[f] / sum(e) >= model.threshold and e[0] / sum(e) < 1 - model.threshold:
                share = max(float(x @ model.notice[i]) / model.size[i] for i in range(len(model.of)) if model.of[i] == f)
                if share >= confirm:
                    yield at + w * half, len(part), model.families[f], e[f] / sum(e), share

    out, alone, at, paragraphs = [], [], 0, [[0, []]]
    for words in lines:
        if not words:
            paragraphs.append([at, []])
        paragraphs[-1][1].append(words)
        alone += windows(words, at)
        at += len(words)
    out += alone
    for begin, part in paragraphs:
        if sum(map(bool, part)) > 1:
            for a, n, family, prob, share in windows([w for x in part for w in x], begin):
                if not any(f == family and a <= b and b + m <= a + n and s >= share for b, m, f, _, s in alone):
                    out.append((a, n, family, prob, share))
    return sorted(out)
