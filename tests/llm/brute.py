"""Slow, plain versions of the operators for small inputs."""

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash


class Ties:
    def __init__(self, n):
        self.up = list(range(n))

    def top(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def tie(self, i, j):
        self.up[max(self.top(i), self.top(j))] = min(self.top(i), self.top(j))


def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    signs = np.array([ord(c) for c in b])
    for i, c in enumerate(a, 1):
        row = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (signs != ord(c)))])
        row = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
    return int(row[-1])


def line_norm(line):
    return re.sub("[ \t\r]+", " ", line.lower()).strip(" ")


def sim_hash(norm):
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(norm.split(" "))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def dedup(docs, similarity=0.9, distance=3, least=25, whole=False):
    """[(key, text)] -> [(key, text of the lines that stay)]; with ``whole`` edit similarity alone makes lines near, and only blank lines are exempt"""
    places = defaultdict(list)
    for key, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            if len(norm := line_norm(line)) >= (1 if whole else least):
                places[norm].append((key, at))
    norms, hashes = list(places), [sim_hash(n) for n in places]
    ties = Ties(len(norms))
    by_length = sorted(range(len(norms)), key=lambda i: len(norms[i]))
    counts = [Counter(n) for n in norms]
    for at, i in enumerate(by_length):
        most = int(len(norms[i]) * (1 - similarity) + 1e-9)
        for j in reversed(by_length[:at]):
            if len(norms[i]) - len(norms[j]) > most:
                break
            # Each edit takes away or adds at most one sign of either line.
            if (whole or (hashes[i] ^ hashes[j]).bit_count() <= distance) and (counts[i] - counts[j]).total() <= most and edit_distance(norms[i], norms[j]) <= most:
                ties.tie(i, j)
    groups = defaultdict(list)
    for i, n in enumerate(norms):
        groups[ties.top(i)] += places[n]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return [(k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in docs]


def links(docs, n=5):
    """[(key, text)] -> {row: (class id, number of links)}"""
    sets = []
    for _, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        size = min(n, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    ties, count = Ties(len(docs)), Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                ties.tie(i, j)
                count[i] += 1
                count[j] += 1
    members = defaultdict(list)
    for i in range(len(docs)):
        members[ties.top(i)].append(docs[i][0])
    return [(docs[i][0], min((k for k in members[ties.top(i)] if k is not None), default=None), count[i]) for i in range(len(docs))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def hits(docs, items, size=10):
    """[(key, text)], [(item, text)] -> [(key, number of words, number of hit words, sorted items)]"""
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    found = []
    for key, text in docs:
        w, hit, who = words(text), set(), set()
        for gram, ids in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    who |= ids
        found.append((key, len(w), len(hit), sorted(who)))
    return found
