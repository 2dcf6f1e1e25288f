"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from lodestone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_capitals": sum("A" <= c <= "Z" for c in text),
    }


def base_failed(c):
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


CHI2 = {0.975: 12.832502, 0.999: 20.515006}  # 5 degrees
CHI2_75 = {1: 1.323304, 2: 2.772589, 3: 4.108345, 4: 5.385269, 5: 6.625680}


def factored(cov):
    """Cholesky factor with the floors in singular directions, and which are regular."""
    p = len(cov)
    low, regular = np.zeros((p, p)), np.zeros(p, bool)
    for i in range(p):
        for j in range(i):
            low[i, j] = (cov[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
        rest = cov[i, i] - low[i, :i] @ low[i, :i]
        regular[i] = rest > quality.FLOORS[i] ** 2
        low[i, i] = math.sqrt(rest) if regular[i] else quality.FLOORS[i]
    return low, regular


def mahalanobis(rows, support=0.75, starts=60):
    """Squared distances by the textbook FAST-MCD: many elemental starts, exact subsets
    of the nearest, the least determinant, one reweighting."""
    x = np.unique(rows, axis=0)
    n, p = x.shape
    rng, h = np.random.default_rng(5), max(math.ceil(n * support), 1)

    def parts(at, mean, low, regular):
        y = np.linalg.solve(low, (at - mean).T) ** 2
        return y[regular].sum(axis=0), y[~regular].sum(axis=0)

    def scale(at, mean, low, regular):
        return np.quantile(parts(at, mean, low, regular)[0], support) / CHI2_75[regular.sum()] if regular.any() else 1.0

    best = None
    for _ in range(starts):
        near = x[rng.choice(n, min(p + 2, n), replace=False)]
        last = math.inf
        while True:
            mean = near.mean(axis=0)
            low, regular = factored(np.cov(near.T, bias=True))
            size = np.log(np.diag(low)).sum()
            if len(near) == h and last - size < 1e-9:
                break
            last = size if len(near) == h else math.inf
            near = x[np.argsort(sum(parts(x, mean, low, regular)), kind="stable")[:h]]
        if best is None or size < best[0]:
            best = (size, mean, low, regular)
    _, *model = best
    d, e = parts(x, *model)
    near = x[d / scale(x, *model) + e <= CHI2[0.975]]
    model = (near.mean(axis=0), *factored(np.cov(near.T, bias=True)))
    d, e = parts(rows, *model)
    return d / scale(x, *model) + e


def distances(docs, min_rows=50):
    """[(d2 or None, counts)] for dicts with text, lang, source."""
    counts = [base_counts(d["text"]) for d in docs]
    good = [i for i, c in enumerate(counts) if not base_failed(c)]
    size = Counter((docs[i]["lang"], docs[i]["source"]) for i in good)
    pool, langs = Counter(), Counter(docs[i]["lang"] for i in good)
    for (lang, _), n in size.items():
        if n < min_rows:
            pool[lang] += n
    members = defaultdict(list)  # of an estimate
    asked = defaultdict(list)  # by whom
    for i in good:
        lang = docs[i]["lang"]
        key = (lang, docs[i]["source"])
        group = (0, key) if size[key] >= min_rows else (1, lang) if pool[lang] >= min_rows else (2, lang) if langs[lang] >= min_rows else (3,)
        asked[group].append(i)
        small = size[key] < min_rows
        for g in [(0, key)] * (not small) + [(1, lang)] * small + [(2, lang), (3,)]:
            members[g].append(i)
    total = {lang: [sum(counts[i][c] for i in good if docs[i]["lang"] == lang) for c in ("n_words", "word_chars", "n_capitals")] for lang in langs}
    x = {i: vector(counts[i], *total[docs[i]["lang"]]) for i in good}
    out = [None] * len(docs)
    for group, who in asked.items():
        if len(members[group]) >= min_rows:
            found = dict(zip(members[group], mahalanobis(np.array([x[i] for i in members[group]]))))
            for i in who:
                out[i] = found[i]
    return list(zip(out, counts))


def judged(docs, min_rows=50):
    """[(kept, counts)] for dicts with text, lang, source."""
    return [(not base_failed(c) and not (d2 is not None and d2 > CHI2[0.999]), c) for d2, c in distances(docs, min_rows)]


def vector(c, all_words, all_chars, all_capitals):
    k = 100
    chars = c["word_chars"] + k * all_chars / all_words
    return (
        math.log(chars / (c["n_words"] + k)),
        math.sqrt((c["n_capitals"] + k * all_capitals / all_words) / chars),
        c["n_symbols"] / (c["n_words"] + k),
        c["n_dup_lines"] / (c["n_lines"] + 10),
        c["n_repeat_words"] / (c["n_words"] + k),
    )


def deduped_lines(docs):
    """[(n_lines, n_dropped, text)] for (id, text) pairs of distinct ids."""
    holders = defaultdict(set)
    split = {i: (t or "").split("\n") for i, t in docs}
    key = lambda x: x.strip(SPACES).translate(LOWER)
    for i, lines in split.items():
        for x in lines:
            if i is not None and len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = split[i]
        stay = [x for x in lines if i is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max(holders[key(x)])]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_components(docs, percent=85):
    """{id: least id reachable} for (id, text) pairs of distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: root(i) for i in ids}


def targets(sizes, weights=(5, 2, 1), cap=3):
    """{source: target} by repeated resharing; sizes: {source: words}."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: float(cap * sizes[s]) for s in full}
        full |= over


def mixed(docs, seed=20, tilt=0.5, cap=3):
    """[copies] for (id, source, size) triples."""
    size = Counter()
    n = Counter()
    for _, s, z in docs:
        size[s] += z
        n[s] += 1
    goal = targets(dict(size))
    copies = [0] * len(docs)
    for s in size:
        mine = [k for k, d in enumerate(docs) if d[1] == s]
        mean = size[s] // max(n[s], 1)
        t = {k: 1024 * docs[k][2] // max(docs[k][2] + mean, 1) for k in mine}
        tm = sum(t[k] * docs[k][2] for k in mine) / max(size[s], 1)
        rho = goal[s] / max(size[s], 1)
        ranked, certain = [], 0
        for k in mine:
            e = max(min(rho + tilt * min(rho, cap - rho) * (t[k] - tm) / 1024, float(cap)), 0.0)
            copies[k] = math.floor(e)
            certain += copies[k] * docs[k][2]
            p = e - math.floor(e)
            if p > 0 and docs[k][2] > 0:
                name = "-" if docs[k][0] is None else f"={docs[k][0]}"
                u = (int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (p / (1 - p)), docs[k][0], docs[k][2], k))
        up = 0
        for _, _, z, k in sorted(ranked, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
            up += z
            if 2 * up - z <= 2 * (goal[s] - certain):
                copies[k] += 1
    return copies
