"""Plain versions of the operators, for comparison on small inputs."""

import re
from itertools import combinations


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_duplicates(rows):
    """rows: (doc_id, text). Per row: doc_id, n_shingles, component_id, kept."""
    sets = [(i, shingles(t)) for i, t in rows]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    posting = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                posting.setdefault(g, []).append(k)
    seen = set()
    for ks in posting.values():
        for a, b in combinations(ks, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                x, y = sets[a][1], sets[b][1]
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    top[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), *((None, True) if i is None else (least[find(k)], least[find(k)] == i))) for k, (i, s) in enumerate(sets)]


def kneser_ney(train, texts, order=5):
    """Perplexity of each text under an interpolated modified Kneser-Ney model of the characters of ``train``."""
    import math
    from collections import Counter

    def grams(text):
        s = "\2" * (order - 1) + text.replace("\0", "␀") + "\3"
        return [s[i : i + order] for i in range(len(s) - order + 1)]

    counts = [Counter(g for t in train if t for g in grams(t))]
    for _ in range(order - 1):
        shorter = Counter(g[1:] for g in counts[0])
        counts.insert(0, shorter)
    discounts = []
    for c in counts:
        n = [max(sum(v == i for v in c.values()), 1) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts.append([0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3)])
    totals, left = [], []
    for c, d in zip(counts, discounts):
        t, x = Counter(), Counter()
        for g, v in c.items():
            t[g[:-1]] += v
            x[g[:-1]] += d[min(v, 3)]
        totals.append(t)
        left.append(x)

    def p(g):
        k = len(g) - 1
        low = p(g[1:]) if k else 1 / (len(counts[0]) + 1)
        t = totals[k].get(g[:-1])
        if not t:
            return low
        v = counts[k].get(g, 0)
        return (v - discounts[k][min(v, 3)] + left[k][g[:-1]] * low) / t

    out = []
    for text in texts:
        if not text or not counts[0]:
            out.append(None)
            continue
        gs = grams(text)
        out.append(math.exp(-sum(math.log(p(g)) for g in gs) / len(gs)))
    return out


def drop_lines(rows, ratio, min_pages):
    """rows: (id, host, text). Texts without the lines above the ratio."""
    from collections import Counter

    pages = Counter(h for _, h, _ in rows)
    seen = Counter()
    for _, h, t in rows:
        seen.update((h, x) for x in {x.strip(" ") for x in (t or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= min_pages and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for i, h, t in rows]


def segmentations(lattice, size, n):
    """All paths through a lattice by exhaustive search, best first: (score, ids)."""
    out = []

    def go(at, score, ids, turns):
        if at == 0:
            out.append((score, turns, ids))
            return
        for start, s, i in lattice[at]:
            go(start, score + s, (i, *ids), (*turns, at - start))

    go(size, 0.0, (), ())
    out.sort(key=lambda x: (-x[0], x[1]))
    return [(s, list(ids)) for s, _, ids in out[:n]]


def contaminated(docs, items, window, agree, least):
    """docs, items: (id, words). Ids of documents some item agrees with, at any diagonal."""
    out = set()
    for i, w in docs:
        for _, b in items:
            if len(b) < least:
                continue
            k = min(window, len(b))
            for d in range(-len(b) + 1, len(w)):
                m = [0 <= d + j < len(w) and w[d + j] == b[j] for j in range(len(b))]
                if max(sum(m[s : s + k]) for s in range(len(b) - k + 1)) >= agree * k:
                    out.add(i)
    return out
