"""Plain versions of the operators, for small inputs."""

import collections
import math
import re

from tokenloom.llm import quality, toxicity

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = components(ids, linked)
    return {i: (len(sets[i]), found[i]) for i in ids}


def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_score(text, terms, precision, worth):
    """The score of a text with a lexicon without word beginnings."""
    words, quotes = [], toxicity.QUOTES
    for m in re.finditer(r"[^\x20\x09-\x0d]+", (text or "").lower()):
        core = [k for k, c in enumerate(m[0]) if c.isalpha() or c in "0123456789"]
        if core:
            words.append((m.start() + core[0], m.start() + core[-1] + 1))
    lower, hits = (text or "").lower(), []

    for w, (a, b) in enumerate(words):
        found = []
        for k, t in enumerate(terms):
            d = distance(lower[a:b], t)
            if d == 0 or (d == 1 and len(t) >= toxicity.FUZZY_LENGTH):
                found.append((d, k))
        if found:
            d, k = min(found)
            low, high = max(0, w - toxicity.WINDOW), min(len(words), w + toxicity.WINDOW + 1) - 1
            start = words[low][0]
            left, right = lower[max(start - 1, 0) : a], lower[b : words[high][1] + 1]
            quoted = sum(c in quotes for c in left) % 2 == 1 and any(c in quotes for c in right)
            quoted |= any(lower[x:y] in toxicity.REPORTING for x, y in words[max(0, w - 3) : w])
            hits.append((w, 2 * k + d, quoted))
    clean = 1.0
    for i, (at, v, quoted) in enumerate(hits):
        near = (i > 0 and at - hits[i - 1][0] <= toxicity.WINDOW) + (i + 1 < len(hits) and hits[i + 1][0] - at <= toxicity.WINDOW)
        clean *= 1 - min(0.999, precision[v] * (1 + toxicity.NEAR * near)) * (worth if quoted else 1.0)
    return 1 - clean * (1 - toxicity.NO_HIT)


def quality_kept(rows, ratios):
    """{id: kept} for rows (id, lang, source); ratios: {id: row with base_failed, n_words and the ratios}."""

    def sketch(which, ratio):
        found = collections.Counter()
        for i, lang, source in rows:
            v = ratios[i]
            if v.n_words > 0 and which(lang, source):
                x = v[ratio]
                found[math.ceil(math.log(x) / math.log(quality.GAMMA)) if x > 0 else -(1 << 30)] += 1
        return found

    def shares(own, parent):
        n, k = sum(own.values()), quality.PRIOR_DOCS if parent else 0
        return {b: (own.get(b, 0) + k * (parent or {}).get(b, 0)) / (n + k) for b in {*own, *(parent or {})}} if n + k else {}

    def quantile(p, q):
        seen = 0.0
        for b in sorted(p):
            seen += p[b]
            if seen >= (q - 1e-9) * sum(p.values()):
                return 0.0 if b == -(1 << 30) else 2 * quality.GAMMA**b / (quality.GAMMA + 1)
        return None

    limits = {}
    for lang, source in {x[1:] for x in rows}:
        for ratio, (side, slack) in quality.RATIOS.items():
            p = shares(sketch(lambda *_: True, ratio), None)
            p = shares(sketch(lambda a, _: a == lang, ratio), p)  # noqa: B023
            p = shares(sketch(lambda a, b: (a, b) == (lang, source), ratio), p)  # noqa: B023
            low, mid, high = (quantile(p, q) for q in (0.25, 0.5, 0.75))
            limits[lang, source, ratio] = (mid - max(quality.SPREAD * (mid - low), slack) if side == "both" else -math.inf, mid + max(quality.SPREAD * (high - mid), slack))
    inside = lambda i, lang, source: all(ratios[i][x] is None or limits[lang, source, x][0] <= ratios[i][x] <= limits[lang, source, x][1] for x in quality.RATIOS)
    return {i: not ratios[i].base_failed and inside(i, lang, source) for i, lang, source in rows}
