"""Plain versions of the operators for small tables, row by row in Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def smallest_reachable(ids, linked):
    """Smallest id reachable from each row; linked(i, j) for row numbers."""
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                up[root(i)] = root(j)
    best = {}
    for k, i in enumerate(ids):
        if i is not None:
            best[root(k)] = min(best.get(root(k), i), i)
    return [best.get(root(k)) if i is not None else None for k, i in enumerate(ids)]


def vector_links(rows):
    """rows: (vec_id, embedding, label)"""
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.sqrt((v**2).sum())

    units = [unit(e) if i is not None and label is not None else None for i, e, label in rows]

    def link(i, j):
        a, b = units[i], units[j]
        return a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and float(a @ b) >= 0.93

    n = [sum(link(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    comp = smallest_reachable(ids, link)
    return Counter((i, k, c, c is None or c == i) for i, k, c in zip(ids, n, comp))


def shingle_set(text):
    w = BLANK_WORDS.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_copies(docs):
    """docs: (doc_id, text)"""
    sets, ids = [shingle_set(t) for _, t in docs], [i for i, _ in docs]

    def link(i, j):
        if ids[i] is None or ids[j] is None:
            return False
        both = len(sets[i] & sets[j])
        return ids[i] == ids[j] or bool(both) and 100 * both >= 85 * len(sets[i] | sets[j])

    comp = smallest_reachable(ids, link)
    return Counter((i, len(s), c, c is None or c == i) for i, s, c in zip(ids, sets, comp))


def contamination(docs, items):
    windows = {}
    for item, text in items:
        w = tuple(ALNUM_WORDS.findall((text or "").translate(LOW)))
        if item is not None and w:
            for i in range(max(1, len(w) - 9)):
                windows.setdefault(w[i : i + 10], set()).add(str(item))
    sizes, out = {len(w) for w in windows}, Counter()
    for doc, text in docs:
        w = tuple(ALNUM_WORDS.findall((text or "").translate(LOW)))
        hit, met = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if w[i : i + n] in windows:
                    met |= windows[w[i : i + n]]
                    hit.update(range(i, i + n))
        out[(doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))] += 1
    return out


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(ids.tobytes())


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    """The patterns of the contract as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, pattern, fits in found for m in re.finditer(pattern, text) if fits(m)]


def without_repeats(docs, length=400):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = Counter()
    for (doc, _), b in zip(docs, raw):
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[: len(b)] > 0
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out
