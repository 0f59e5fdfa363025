"""Plain models of the text operators, one document at a time."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def visible(text):
    return VISIBLE.findall(text or "")


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def repeats(rows, length=50):
    """Removed byte masks of (key, text) rows."""
    last = float("inf")
    first = {}
    for key, text in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], last if key is None else key)
    masks = []
    for key, text in rows:
        raw = (text or "").encode()
        mask = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (last if key is None else key):
                mask[i : i + length] = b"\1" * length
        masks.append(mask)
    return masks


def contaminated(text, items, window=10):
    """(n_words, covered word places, item ids) of a text."""
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        for k in range(max(1, len(v) - window + 1)) if v else []:
            part = v[k : k + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit.update(range(i, i + len(part)))
                    found.add(str(key))
    return len(w), hit, found


def links(texts, similarity=0.8):
    """Pairs of different shingle sets that are similar enough."""
    sets = sorted({shingles(t) for t in texts if words(t)}, key=sorted)
    return {
        frozenset((a, b))
        for i, a in enumerate(sets)
        for b in sets[i + 1 :]
        if len(a & b) >= similarity * len(a | b) - 1e-9
    }
