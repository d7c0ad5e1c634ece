"""The operators in plain Python, one text at a time, from their definitions: what tests compare Spark's results with."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def crc_rest(doc_id, modulus):
    import zlib

    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % modulus


class KneserNey:
    """Interpolated modified Kneser-Ney over bigrams of words between a begin and an end."""

    def __init__(self, texts):
        self.pairs, self.ahead = Counter(), defaultdict(Counter)
        words = Counter()
        for t in texts:
            seq = [" begin", *WORD.findall(lower(t)), " end"]
            words.update(seq[1:])
            self.pairs.update(zip(seq[:-1], seq[1:], strict=True))
        before = defaultdict(set)
        for (a, b), n in self.pairs.items():
            before[b].add(a)
            self.ahead[a][min(n, 3)] += 1
            self.ahead[a]["total"] += n
        self.before = {b: len(x) for b, x in before.items()}
        self.vocabulary = len(words)
        self.d = self.discounts(Counter(self.pairs.values()))
        self.low = self.discounts(Counter(self.before.values()))
        self.spread = sum(self.low[min(x, 3)] for x in self.before.values()) / max(len(self.pairs), 1)

    @staticmethod
    def discounts(n):
        if not all(n[i] for i in (1, 2, 3)):
            return [0.0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
        return [0.0] + [x if x > 0 else y for x in d]

    def lower_order(self, w):
        total = len(self.pairs)
        n = self.before.get(w, 0)
        return max(n - self.low[min(n, 3)], 0) / total + self.spread / (self.vocabulary + 1)

    def probability(self, a, w):
        total = self.ahead[a]["total"]
        if not total:
            return self.lower_order(w)
        n = self.pairs.get((a, w), 0)
        left = sum(self.d[i] * self.ahead[a][i] for i in (1, 2, 3)) / total
        return max(n - self.d[min(n, 3)], 0) / total + left * self.lower_order(w)

    def score(self, text):
        seq = [" begin", *WORD.findall(lower(text)), " end"]
        return sum(math.log10(self.probability(a, w)) for a, w in zip(seq[:-1], seq[1:], strict=True))


def letter_runs(text):
    return [r for w in WORD.findall(text or "") for r in regex.sub(r"[^\p{L}\p{M}]+\p{M}*|^\p{M}+", " ", w.lower()).split()]


class Languages:
    """Word-first backoff."""

    def __init__(self, rows, max_n=5):
        counts, self.max_n = defaultdict(Counter), max_n
        for text, lang in rows:
            for run in letter_runs(text):
                counts[lang, 0][run] += 1
                padded = f" {run} "
                for n in range(1, max_n + 1):
                    counts[lang, n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
        self.langs = sorted({lang for lang, _ in counts})
        self.counts, self.total = counts, {k: sum(c.values()) for k, c in counts.items()}
        self.unknown = [math.log10(max(self.total.get((x, n), 1) for x in self.langs)) + 1 if self.langs else 0 for n in range(max_n + 1)]

    def entry(self, what, n):
        costs = [-math.log10(self.counts[x, n][what] / self.total[x, n]) if self.counts[x, n][what] else None for x in self.langs]
        return None if all(c is None for c in costs) else [self.unknown[n] if c is None else c for c in costs]

    def cost(self, run):
        if (own := self.entry(run, 0)) is not None:
            return own
        padded = f" {run} "
        for n in range(self.max_n, 0, -1):
            found = [e for i in range(len(padded) - n + 1) if (e := self.entry(padded[i : i + n], n)) is not None]
            if found:
                return [sum(c) / len(found) for c in zip(*found, strict=True)]
        return [self.unknown[0]] * len(self.langs)

    def predict(self, text):
        runs = letter_runs(text)
        if not self.langs or not runs:
            return "und", 0.0
        mean = [sum(c) / len(runs) for c in zip(*map(self.cost, runs), strict=True)]
        best = min(mean)
        return self.langs[mean.index(best)], 1 / sum(10 ** (best - m) for m in mean)


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def quality_buckets(text, buckets):
    parts = [p for w in WORD.findall(lower(text)) for p in regex.findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+", w)]
    h = [xxhash.xxh3_64_intdigest(p) for p in parts]
    return [x % buckets for x in h] + [mix((mix(a) + b) & MASK) % buckets for a, b in zip(h[:-1], h[1:], strict=True)]


def quality_scores(texts, good, buckets):
    """Mean log ratios; good holds whether each text is trusted."""
    raw, trusted = Counter(), Counter()
    for t, g in zip(texts, good, strict=True):
        found = quality_buckets(t, buckets)
        raw.update(found)
        trusted.update(found if g else [])
    a, b = sum(trusted.values()) + buckets, sum(raw.values()) + buckets
    ratio = lambda k: math.log((trusted[k] + 1) / a) - math.log((raw[k] + 1) / b)
    return [sum(map(ratio, found)) / len(found) if (found := quality_buckets(t, buckets)) else 0.0 for t in texts]


def base_secrets(text):
    """(kind, start, end) of the three fixed kinds, by scanning characters where that is plain enough."""
    text, found = text or "", []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, m.end()))
    i = 0
    while (i := text.find("AKIA", i)) >= 0:
        j = i + 4
        while j < len(text) and (text[j].isascii() and (text[j].isdigit() or "A" <= text[j] <= "Z")):
            j += 1
        if j == i + 4:
            i += 4
            continue
        if j - i >= 18:
            found.append((i, 1, j))
        i = j
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "0123456789abcdef":
            j += 1
        if j - i >= 16:
            found.append((i, 2, j))
        i = max(j, i + 1)
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def shingles(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts, n, percent):
    """The first index of each text's component."""
    sets, top = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) if sets[i] else i for i in range(len(texts))]


def poisson_count(rate, key, seed="mix"):
    """A document's copies: a sum of parts with means of at most 32, each inverted at a number of its own."""
    parts, n = max(math.ceil(rate / 32), 1), 0
    for j in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}:{j}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, term = 0, math.exp(-rate / parts)
        upto = term
        while upto <= u:
            k += 1
            term *= rate / parts / k
            upto += term
        n += k
    return n
