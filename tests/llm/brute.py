"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def repeats(rows):
    """(n_words, n_removed, digest) by row; rows are (doc_id, text)."""
    least = {}
    split = [(d if d is not None else 1 << 63, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i:i + 13])] < d for j in range(i, i + 13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(w) - len(kept), sha(b" ".join(kept))))
    return out


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius=3):
    """Smallest id reachable over links, by id."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for x, i in enumerate(order):
        for j in order[:x]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                if ids[a] < ids[b]:
                    root[b] = a
                else:
                    root[a] = b
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def greedy(word, initial, following):
    """Greedy longest-match pieces; 0 if the word cannot be spelt."""
    i = n = 0
    while i < len(word):
        vocab = initial if i == 0 else following
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocab), None)
        if j is None:
            return 0
        i, n = j, n + 1
    return n


def url(u, rules):
    """(host, path, rule, verdict of the rule)."""
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m[1], m[2]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, text in rules:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = verdict, text
    return (host, path, best[1], best[0]) if best else (host, path, None, None)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
