"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def decontaminate(docs, items, window=10):
    grams = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - window + 1)):
            grams[tuple(w[i : i + window])].add(str(item))
    lengths = sorted({len(g) for g in grams})
    out = []
    for doc, text in docs:
        w = BENCH_WORD.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= g
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repetition(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)))
    return out


def repetition_rules(docs, lengths, line_share):
    """Word characters of repeated lines and inside repeated windows of each length, and the verdict."""
    out = []
    base = {id(d): r for d, r in zip(docs, repetition(docs), strict=True)}
    for row in docs:
        text = row[1] or ""
        w = WORD.findall(text)
        chars, seen, lines = sum(map(len, w)), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                lines += sum(map(len, WORD.findall(line))) if line in seen else 0
                seen.add(line)
        covered = {}
        for n in lengths:
            grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            covered[n] = sum(len(w[j]) for j in {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})
        good = lines <= line_share * chars and all(covered[n] <= most * chars for n, most in lengths.items())
        out.append((row[0], lines, *covered.values(), good and not base[id(row)][-1]))
    return out


def shingles(text, size):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(docs, size=4, percent=80):
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]


def tokens(docs, tokenizer, end=0):
    out, start = [], 0
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out
