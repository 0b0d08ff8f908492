"""Small independent single-machine checks used by the tests only."""

import gzip
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

P31 = 2**31 - 1


def squash(text):
    return " ".join(text.split())


def shingle_set(text, k=5):
    s = squash(text)
    if not s:
        return set()
    return {s} if len(s) <= k else {s[i:i + k] for i in range(len(s) - k + 1)}


def minhash(text, k=5, n=64):
    rng = np.random.default_rng(1234)
    a = rng.integers(1, P31, size=n, dtype=np.int64)
    b = rng.integers(0, P31, size=n, dtype=np.int64)
    pieces = shingle_set(text, k)
    if not pieces:
        return [0] * n
    hashes = [zlib.crc32(p.encode()) % P31 for p in pieces]
    return [min((int(x) * h + int(y)) % P31 for h in hashes) for x, y in zip(a, b)]


def greedy(texts, threshold=0.6, n=64, bands=16):
    r = n // bands
    sigs = [minhash(t, n=n) for t in texts]
    kept = []
    for i, sig in enumerate(sigs):
        def clash(j):
            other = sigs[j]
            share = any(sig[q * r:(q + 1) * r] == other[q * r:(q + 1) * r] for q in range(bands))
            return share and sum(x == y for x, y in zip(sig, other)) / n >= threshold
        if not any(clash(j) for j in kept):
            kept.append(i)
    return kept


def entropy(text):
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def merge_ids(ids, pair, new):
    out, i = [], 0
    while i < len(ids):
        if tuple(ids[i:i + 2]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def bpe(text, merges):
    base = sorted(set(text))
    ids = [base.index(c) for c in text]
    vocab, rules, log = list(base), [], []
    for _ in range(merges):
        counts = {}
        for pair in zip(ids, ids[1:]):
            counts[pair] = counts.get(pair, 0) + 1
        if not counts:
            break
        best = max(counts, key=counts.get)
        if counts[best] < 2:
            break
        ids = merge_ids(ids, best, len(vocab))
        rules.append((*best, len(vocab)))
        vocab.append(vocab[best[0]] + vocab[best[1]])
        log.append((counts[best], len(ids)))
    return base, rules, log, ids


def symbol_share(text):
    if not text:
        return 1.0
    bad = [c for c in text if not (c.isalnum() or c.isspace() or "一" <= c <= "鿿")]
    return len(bad) / len(text)


def top_share(text):
    counts = Counter(c for c in text if not c.isspace())
    return max(counts.values()) / sum(counts.values()) if counts else 1.0


def tidy(text):
    """Cleaning without the variant markup."""
    text = unicodedata.normalize("NFC", text)
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r"\n{3,}", "\n\n", text)
    return "\n".join(part.rstrip() for part in text.split("\n")).strip()


def gzip_share(text, level=6):
    raw = text.encode()
    return len(gzip.compress(raw, compresslevel=level)) / len(raw) if raw else 0.0
