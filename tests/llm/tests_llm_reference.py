"""Brute-force forms of operators on rows (doc_id, text, ...)."""

import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bytes_removed(rows, length):
    first, out = {}, {}
    for d, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first.setdefault(raw[k : k + length], (d, k)) < (d, k):
                gone[k : k + length] = True
        out[d] = raw, gone
    return out


def shingles(text, width):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)}


def linked(rows, width, percent):
    sets = {}
    for d, text, *_ in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(text, width))
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {d: top(d) for d in sets}
