"""Plain reference versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def jaccard_components(docs, size, percent):
    sets = {}
    for key, text in docs:
        w = WORD.findall(low(text))
        sets[key] = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for key, grams in sets.items():
        for g in grams:
            holders.setdefault(g, []).append(key)
    for key, grams in sets.items():
        common = Counter(other for g in grams for other in holders[g] if other < key)
        for other, n in common.items():
            if 100 * n >= percent * (len(grams) + len(sets[other]) - n):
                a, b = root(key), root(other)
                parent[max(a, b)] = min(a, b)
    return sorted((key, len(sets[key]), root(key)) for key in sets)


def decontaminated(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = FOLDED.findall(low(text))
        if w:
            for k in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for key, text in docs:
        w = FOLDED.findall(low(text))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                gram = tuple(w[k : k + size])
                if gram in windows:
                    found |= windows[gram]
                    hit |= set(range(k, k + size))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def base_scores(docs):
    rows = [(key, WORD.findall(low(text)) + [""]) for key, text in docs]
    counts = Counter()
    for key, tokens in rows:
        if zlib.crc32(str(key).encode()) % 10:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    return {
        key: (
            zlib.crc32(str(key).encode()) % 10 == 0,
            len(tokens),
            sum(t in counts for t in tokens),
            n,
            sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens),
        )
        for key, tokens in rows
    }


def class_scores(docs, model):
    """log10 probability of each text, one token at a time, in plain integers and floats."""
    low64 = (1 << 64) - 1
    k, rows = 0x9E3779B97F4A7C15, len(model.weights)

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & low64
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & low64
        return x ^ x >> 31

    def place(x):
        return (x >> 32) * rows >> 32

    def kind(word):
        if not word:
            return 0
        return model.top.get(word) or 16 + zlib.crc32(word[-3:]) % 16

    texts = {key: [w.encode() for w in WORD.findall(low(text))] + [b""] for key, text in docs}
    counts = Counter(w for key, words in texts.items() if zlib.crc32(str(key).encode()) % 10 for w in words)
    class_tokens, class_words = Counter(), Counter(map(kind, counts))
    for word, n in counts.items():
        class_tokens[kind(word)] += n
    known, scores = {}, {}
    for key, words in texts.items():
        score, past = 0.0, (b"", b"", b"")
        for word in words:
            if past not in known:
                h = [xxhash.xxh3_64_intdigest(w) for w in past]
                pair = mix((mix((h[0] + k) & low64) * k + h[1]) & low64)
                alone = [mix((x * k + i) & low64) for i, x in enumerate(h)]
                z = model.bias.astype(float) + sum(model.weights[place(x)].astype(float) for x in (pair, *alone))
                known[past] = z - math.log(sum(math.exp(x) for x in z))
            score += known[past][kind(word)] / math.log(10)
            score += math.log10((counts[word] + 0.1) / (class_tokens[kind(word)] + 0.1 * (class_words[kind(word)] + 1)))
            past = (word, *past[:2])
        scores[key] = score
    return scores


def cut_repeats(docs, length=100):
    seen, out = set(), []
    for key, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                covered[p : p + length] = b"\x01" * length
            seen.add(raw[p : p + length])
        kept = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((key, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def kept_lines(docs, least=20, rare=50):
    """Line dedup for documents whose lines are all different within themselves and
    whose shared lines stand in one order: then patience diff is a common run."""
    first, lines_of = {}, {}
    for key, text in sorted(docs):
        lines_of[key] = [" ".join(line.split()) for line in low(text).split("\n")]
        for line in lines_of[key]:
            first.setdefault(line, key)
    return first, lines_of


def lines_in_common_runs(a, b, words, least):
    """Positions of b inside a run of ``least`` words or more that a has as well."""
    gone = set()
    for s in range(len(b)):
        for e in range(s + 1, len(b) + 1):
            if sum(words[s:e]) >= least and any(a[k : k + e - s] == b[s:e] for k in range(len(a))):
                gone |= set(range(s, e))
    return sorted(gone)
