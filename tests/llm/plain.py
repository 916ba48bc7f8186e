"""Plain, single-machine versions of operators, for the tests to compare with."""

import hashlib
import re
import zlib
from fractions import Fraction


def periodic_runs(words):
    """Every (start, length, period) by trying all periods at all places."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_digest(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = periodic_runs(words)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else None
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def mined_negatives(rows):
    """(anchor, positive, rank, negative, positive score, negative score) from (vec_id, embedding, label) rows, by all pairs."""
    import math

    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        good.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, va, la in good:
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, v, label in good if i != a))
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            window = [x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(window[:5])]
    return sorted(out)
