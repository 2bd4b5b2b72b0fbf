"""Brute-force versions of operators."""

import itertools
import re


def brute_components(texts, numerator, denominator):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    return {k: (len(sets[k]), group[k]) for k in sets}


def brute_removed(texts, length):
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out[k] = (bytes(b for b, g in zip(raw, gone) if not g), len(re.findall(b"\1+", bytes(gone))))
    return out


def brute_targets(sizes, epochs=3, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > epochs * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: epochs * sizes[s] for s in above}
