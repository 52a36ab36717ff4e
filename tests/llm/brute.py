"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash

SECRET = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(SECRET, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def luhn(digits):
    return sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    """Least reachable node of each of ``nodes`` (key to value), values being linked if ``near``."""
    keys = sorted(nodes)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(nodes[a], nodes[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def chunks(text):
    """Chunks of lines (lists) as line deduplication cuts them."""
    out, block, before = [], [], 0
    for line in text.split("\n"):
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        block.append(line)
        if (before * 31 + h) % 3 == 0:
            out.append(block)
            block = []
        before = h
    return out + ([block] if block else [])


def dedup_lines(rows):
    """doc_id to (text, chunks, removed) for rows with distinct doc_ids."""
    cut = {d: chunks(t) for d, t in rows if t is not None}
    places = {}
    for d in sorted(cut):
        for i, c in enumerate(cut[d]):
            if len(c) > 1:
                places.setdefault(tuple(c), []).append((d, i))
    gone = {p for at in places.values() for p in at[1:]}
    out = {d: (None, 0, 0) for d, t in rows if t is None}
    for d, cs in cut.items():
        kept = ["\n".join(c) for i, c in enumerate(cs) if (d, i) not in gone]
        out[d] = ("\n".join(kept), len(cs), len(cs) - len(kept))
    return out


def best_fit_decreasing(lengths, capacity):
    """Number of bins of the plain algorithm, one piece after the other."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return len(left)
