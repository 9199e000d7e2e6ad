"""Plain Python counterparts of the operators, quadratic where they like."""

import hashlib
import re
from collections import Counter

import numpy as np

BLANK = re.compile("[\\x20\\x09-\\x0D]")


def text_of(row):
    return row[1] or ""


def exact(docs):
    """(doc_id, keep_id, group_size, kept rows of the group with that id, sha) per row."""
    groups = {}
    for k, row in enumerate(docs):
        groups.setdefault(BLANK.sub("", text_of(row)), []).append(k)
    out = []
    for content, members in groups.items():
        best = min(members, key=lambda k: (-len(text_of(docs[k])), docs[k][0] is None, docs[k][0] or 0, k))
        for k in members:
            out.append((docs[k][0], docs[best][0], len(members), k == best, hashlib.sha256(content.encode()).hexdigest()))
    return out


def repeats(docs, span):
    """(doc_id, n_removed, n_spans, sha of what is left) per row."""
    texts = [text_of(r).encode() for r in docs]
    seen = Counter(t[s : s + span] for t in texts for s in range(len(t) - span + 1))
    out = []
    for row, t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - span + 1):
            if seen[t[s : s + span]] > 1:
                gone[s : s + span] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((row[0], int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def simhash(text, shingle=4):
    import xxhash

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\\x20\\x09-\\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs, shingle=4, radius=4):
    """(doc_id, fingerprint, component_id) per row, by comparing all pairs."""
    codes = [simhash(text_of(r), shingle) for r in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = {}
    for k, row in enumerate(docs):
        if row[0] is not None:
            ids[find(k)] = min(ids.get(find(k), row[0]), row[0])
    return [(row[0], f"{c:016x}", ids.get(find(k))) for k, (row, c) in enumerate(zip(docs, codes))]
