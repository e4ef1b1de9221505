"""Plain-Python versions of what the text operators compute, straight from their definitions."""

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    ws = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    n, rep = len(ws), len(covered)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, rep, n < 20 or 100 * rep > 30 * n


def fingerprint(text, k=4):
    ws = words(lower(text))
    shingles = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, radius=4):
    """Smallest id reachable over links of at most ``radius`` differing bits, per position."""
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (best.get(r) is None or d < best[r]):
            best[r] = d
    return [best.get(find(i)) for i in range(len(ids))]


def normal_line(line):
    """A line as the line rules compare it: words, A-Z lowered, digits alike."""
    return tuple(re.sub("[0-9]", "0", w) for w in words(lower(line)))
