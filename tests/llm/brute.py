"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(texts, n, similarity):
    """Smallest reachable id by id."""
    sets = {d: shingles(t, n) for d, t in texts.items()}
    label = {d: d for d in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def greedy_pieces(word, vocabulary, longest):
    data, n = b" " + word.encode(), 0
    while data:
        size = next(k for k in range(min(longest, len(data)), 0, -1) if data[:k] in vocabulary)
        data, n = data[size:], n + 1
    return n


def targets(sizes, most=3):
    """Target by source: shares by weight, the excess of full sources reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(1 + i % 3) for i, s in enumerate(order)}
    total, target, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        share = total / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = Fraction(most * sizes[s])
            total -= target[s]
        free -= over
    return target


def base_scores(texts):
    """(held out, tokens, known, training tokens, base score) of each (doc_id, text)."""
    tokens = {d: [*words(t), "\n"] for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in texts}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens.items()}


def edited(texts):
    """Edited text by id: the last third replaced by as much of the next document."""
    ids = sorted(texts, reverse=True)
    out = {}
    for i, d in enumerate(ids):
        text, following = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        k = len(text) // 3
        out[d] = text[: len(text) - k] + following[:k]
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
