"""Plain Python versions of the queries' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, bits=4):
    """rows: (doc_id, text) -> {doc_id: (fingerprint, component_id)}"""
    fps = {d: fingerprint(t) for d, t in rows}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def removed(rows, length=100):
    """rows: (doc_id, text) -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        cover = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(data, cover) if not m)
        out[doc] = (len(data), sum(cover), len(re.findall(b"\1+", bytes(cover))), sha(kept))
    return out


def hits(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[i : i + window])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[t]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())
