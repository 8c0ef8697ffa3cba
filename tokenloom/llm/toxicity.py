"""Toxicity by a learned lexicon, matched within edit distance 1, and scores of the context of each hit.

The lexicon is learned from labelled rows: words, and word beginnings with many different endings, that are far more
frequent in toxic documents. Its terms form a trie; the Levenshtein automaton of distance 1 runs over the trie, and
the states reachable together are joined into one table, so that a word is matched by one table look-up a character.
Each hit gets the precision that its term has on the sample at that distance; a verdict without a hit in the sample gets
the pooled precision of all hits at distance 1, with a fixed prior, at every size of the sample. Its context, WINDOW words on
either side, then changes it: hits nearby add to it, and quotation marks around it or a word of reporting just before it
multiply it by what such hits are worth on the sample: their precision over that of the other hits, with QUOTED as a
prior of weight PRIOR. A document's score is the chance that at least one hit is abuse.

Labels are read from at most about SAMPLE_TOXIC toxic and SAMPLE_CLEAN other documents outside the held-out fold.

Defined cases: null and empty texts, and all texts if no term is learned, get the score of a text without hits;
several labels of one document count as toxic if one is; equal texts get equal scores; very long
texts are scored whole, a batch of their own; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, mix, remainder, shingle_sets, slices
from tokenloom.llm.langid import letters

SAMPLE_TOXIC = 4000
SAMPLE_CLEAN = 12000
#: A term occurs in this share of the toxic sample at least (and in MIN_TOXIC documents), this many times as often as in the rest.
MIN_SHARE, MIN_TOXIC, RATIO = 0.01, 3, 30.0
#: Minima of shingle hashes by which near copies are known in the sample.
MARKS = 8
#: Terms that chance alone may put into the lexicon.
CHANCE = 0.05
#: Word beginnings: characters, and different words that share one.
STEM, STEM_WORDS, STEM_RATIO = (4, 5, 6), 8, 300.0
#: Terms with fewer characters must be met exactly.
FUZZY_LENGTH = 5
WINDOW = 8
#: Prior of what a hit in a quotation is worth.
QUOTED = 0.35
NEAR = 0.15
NO_HIT = 0.02
#: Prior of the precision of distance-1 hits, which the sample's hits at that distance are added to, its weight in hits, and the least precision that counts.
UNSEEN, PRIOR, LEAST = 0.6, 4.0, 0.55

# Quotation marks, and words of reporting.
QUOTES = "\"“”„«»‹›「」"
REPORTING = ("said", "says", "quote", "quoted", "quotes", "wrote", "writes", "called", "word", "term", "insult", "cited")


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, end, row) of the words of all texts: runs without white space, trimmed to letters and digits."""
    lowered = [f"{(t or '').lower()} " for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    n = len(chars)
    solid = (chars != 32) & ((chars < 9) | (chars > 13))
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    core = letters()[chars] | ((chars >= 48) & (chars <= 57))
    at = np.arange(n)
    following = np.minimum.accumulate(np.where(core, at, n)[::-1])[::-1] if n else at
    before = np.maximum.accumulate(np.where(core, at, -1)) if n else at
    starts, ends = (following[starts], before[ends - 1] + 1) if len(starts) else (starts, ends)
    keep = starts < ends
    starts, ends = starts[keep], ends[keep]
    return chars, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Automaton:
    """The table of all words within distance 1 of a term. Terms that end in `*` match any word that begins so."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[dict[str, int]] = [{}]
        fuzzy = [False]
        for k, term in enumerate(terms):
            stem = term.rstrip("*")
            node = 0
            for c in stem:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append({})
                    fuzzy.append(False)
                node = children[node][c]
                fuzzy[node] |= len(stem) >= FUZZY_LENGTH
            ends[node]["*" if term.endswith("*") else "$"] = k
        fuzzy[0] = any(fuzzy)
        alphabet = sorted({c for x in children for c in x})
        self.classes = {ord(c): i + 1 for i, c in enumerate(alphabet)}
        self.longest = max((len(t) for t in terms), default=0) + 2

        def close(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With the states reached by leaving out a character of a term; a stem that is met stays met (node < 0)."""
            out = set(states)
            for node, e in states:
                if node >= 0 and e == 0:
                    out |= {(x, 1) for x in children[node].values() if fuzzy[x]}
            out |= {(-1 - ends[node]["*"], e) for node, e in out if node >= 0 and "*" in ends[node] and (e == 0 or len(terms[ends[node]["*"]]) > FUZZY_LENGTH)}
            return frozenset(x for x in out if not (x[1] == 1 and (x[0], 0) in out))

        def step(states: frozenset[tuple[int, int]], c: str | None) -> frozenset[tuple[int, int]]:
            out = set()
            for node, e in states:
                if node < 0:
                    out.add((node, e))
                    continue
                if c in children[node]:
                    out.add((children[node][c], e))
                if e == 0 and fuzzy[node]:
                    out.add((node, 1))
                    out |= {(x, 1) for x in children[node].values() if fuzzy[x]}
            return close(out)

        def verdict(states: frozenset[tuple[int, int]]) -> int:
            """Twice the term plus the distance of the nearest term that a word ending here matches, or -1."""
            found = [(e, -1 - node) for node, e in states if node < 0]
            found += [(e, ends[node]["$"]) for node, e in states if node >= 0 and "$" in ends[node] and (e == 0 or len(terms[ends[node]["$"]]) >= FUZZY_LENGTH)]
            return 2 * min(found)[1] + min(found)[0] if found else -1

        start = close({(0, 0)}) if terms else frozenset()
        numbers = {frozenset(): 0, start: 1} if terms else {frozenset(): 0}
        rows: list[list[int]] = []
        accept: list[int] = []
        todo = list(numbers)
        for states in todo:
            row = []
            for c in (None, *alphabet):
                to = step(states, c)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append(numbers[to])
            rows.append(row)
            accept.append(verdict(states))
        self.table = np.asarray(rows, np.int32)
        self.accept = np.asarray(accept, np.int32)
        self.stays = np.asarray([any(node < 0 for node, _ in s) for s in todo])

    def match(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, verdict) of every word that matches."""
        if not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        number = np.zeros(0x110000, np.int32)
        for c, i in self.classes.items():
            number[c] = i
        width = self.table.shape[1]
        flat = self.table.ravel()
        live, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        found, said = [], []
        for k in range(self.longest + 1):
            ended = ends[live] - starts[live] == k
            hit = ended & (self.accept[state] >= 0)
            found.append(live[hit])
            said.append(self.accept[state[hit]])
            live, state = live[~ended], state[~ended]
            if not len(live):
                break
            state = flat[state * width + number[chars[starts[live] + k]]]
            alive = state != 0
            live, state = live[alive], state[alive]
        hit = self.stays[state]
        found.append(live[hit])
        said.append(self.accept[state[hit]])
        found, said = np.concatenate(found), np.concatenate(said)
        order = np.argsort(found, kind="stable")
        return found[order], said[order]


def hits_by_row(automaton: Automaton, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, bool]]]]:
    """(row, its hits): position of the word in its text, verdict, and whether the context is a quotation."""
    chars, starts, ends, row = words_of(texts)
    found, said = automaton.match(chars, starts, ends)
    if not len(found):
        return
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    quotes = [ord(c) for c in QUOTES]
    current, hits = -1, []
    for w, v in zip(found.tolist(), said.tolist(), strict=True):
        r = int(row[w])
        if r != current:
            if hits:
                yield current, hits
            current, hits = r, []
        low, high = max(begin[r], w - WINDOW), min(begin[r + 1], w + WINDOW + 1) - 1
        left, right = chars[starts[low] - (starts[low] > 0) : starts[w]], chars[ends[w] : ends[high] + 1]
        quoted = bool(np.isin(left, quotes).sum() % 2 and np.isin(right, quotes).any())
        lead = [chars[starts[i] : ends[i]].tobytes().decode("utf-32-le") for i in range(max(begin[r], w - 3), w)]
        hits.append((w - int(begin[r]), v, quoted or any(x in REPORTING for x in lead)))
    yield current, hits


def without_echoes(sample: DataFrame) -> DataFrame:
    """(text, toxic, weight): near copies share a weight of about 1, so that a much-copied text is not taken for many.

    A text's weight is one over the most texts that have one of its MARKS minima of shingle hashes.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, bounds = shingle_sets(batch.column("text"))
            some = np.flatnonzero(np.diff(bounds))
            columns = [pa.array(np.tile(some, MARKS)), pa.array(np.repeat(np.arange(MARKS, dtype=np.int32), len(some)))]
            least = [np.minimum.reduceat(mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), bounds[some]) for k in range(MARKS)] if len(some) else [np.zeros(0, np.uint64)]
            digest = batch.column("digest").take(columns[0])
            yield pa.RecordBatch.from_arrays([digest, columns[1], pa.array(np.concatenate(least).view(np.int64))], ["digest", "k", "mark"])

    each = sample.mapInArrow(marks, "digest string, k int, mark long")
    shared = each.groupBy("k", "mark").agg(F.count("*").alias("n"))
    weights = each.join(shared, ["k", "mark"]).groupBy("digest").agg((1 / F.max("n")).alias("weight"))
    return cut(sample.join(weights, "digest", "left").select("text", "toxic", F.coalesce("weight", F.lit(1.0)).alias("weight")))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_column: str = "doc_id", text: str = "text") -> tuple[Automaton, np.ndarray, float]:
    """The automaton, the precision of each verdict on the sample, and what a hit in a quotation is worth."""
    train = labels.where((remainder(id_column, folds) != held_out) & F.col("toxic").isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.lit("toxicity sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, SAMPLE_TOXIC / max(n.get(1, 0), 1)).otherwise(SAMPLE_CLEAN / max(n.get(0, 0), 1))
    chosen = train.where(chance < share)
    sample = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").where(F.col("text").isNotNull())
    sample = without_echoes(cut(sample.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))))
    total = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            chars, starts, ends, row = words_of(batch.column("text").to_pylist())
            plain = chars.tobytes().decode("utf-32-le")
            found = sorted({(r, plain[a:b]) for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True) if 3 <= b - a <= 24})
            toxic, weight = batch.column("toxic").to_pylist(), batch.column("weight").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in found], pa.string()), pa.array([toxic[r] for r, _ in found], pa.int32()), pa.array([weight[r] for r, _ in found], pa.float64())], ["word", "toxic", "weight"])

    bad, good = F.round(F.sum(F.col("toxic") * F.col("weight")), 6).alias("bad"), F.round(F.sum((1 - F.col("toxic")) * F.col("weight")), 6).alias("good")
    seen = sample.mapInArrow(count, "word string, toxic int, weight double").groupBy("word").agg(bad, good)
    seen = cut(seen)
    stems = F.explode(F.array(*(F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEM)))
    starts_ = seen.select(stems.alias("word"), "bad", "good").where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.when(F.col("bad") > 0, 1)).alias("words")).where(F.col("words") >= STEM_WORDS).drop("words")
    least = max(MIN_TOXIC, MIN_SHARE * total.get(1, 0))
    ratio = (F.col("bad") / max(total.get(1, 0), 1)) / ((F.col("good") + 0.5) / max(total.get(0, 0), 1))
    candidates = seen.unionByName(starts_).where(F.col("bad") >= MIN_TOXIC)
    base = min(max(total.get(1, 0) / max(sum(total.values()), 1), 1e-6), 1 - 1e-6)
    part = F.col("bad") / (F.col("bad") + F.col("good"))
    evidence = F.col("bad") * F.log(part / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - part) / (1 - base))).otherwise(0.0)
    chance_found = math.log(max(candidates.count(), 1) / CHANCE)
    lexicon = candidates.where((F.col("bad") >= least) & (ratio >= F.when(F.col("word").endswith("*"), STEM_RATIO).otherwise(RATIO)) & (evidence >= chance_found))
    terms = [r.word for r in lexicon.collect()]  # each in MIN_SHARE of a bounded sample
    stem_terms = sorted({t for t in terms if t.endswith("*")}, key=len)
    stem_terms = [t for i, t in enumerate(stem_terms) if not any(t[:-1].startswith(s[:-1]) for s in stem_terms[:i])]
    terms = sorted(stem_terms + [t for t in terms if not t.endswith("*") and not any(t.startswith(s[:-1]) for s in stem_terms)])
    automaton = Automaton(terms)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            toxic, weight = batch.column("toxic").to_pylist(), batch.column("weight").to_pylist()
            hits = list(hits_by_row(automaton, batch.column("text").to_pylist()))
            rows = sorted({(v, r) for r, found in hits for _, v, _ in found})
            # whether all of a text's hits are quoted (-1) or some are not (-2)
            rows += [(-1 if all(q for _, _, q in found) else -2, r) for r, found in hits]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in rows], pa.int32()), pa.array([toxic[r] for _, r in rows], pa.int32()), pa.array([weight[r] for _, r in rows], pa.float64())], ["verdict", "toxic", "weight"])

    tallied = sample.mapInArrow(tally, "verdict int, toxic int, weight double").groupBy("verdict").agg(bad, F.sum("weight").alias("n")).collect()
    counts, contexts = [r for r in tallied if r.verdict >= 0], {r.verdict: r for r in tallied if r.verdict < 0}
    clean_weight = max(n.get(0, 0) / SAMPLE_CLEAN, 1.0) / max(n.get(1, 0) / SAMPLE_TOXIC, 1.0)
    good_weight = max(1.0, clean_weight)
    bad_near, n_near = sum(r.bad for r in counts if r.verdict % 2), sum(r.n for r in counts if r.verdict % 2)
    precision = np.full(2 * len(terms), (bad_near + PRIOR * UNSEEN) / (bad_near + good_weight * (n_near - bad_near) + PRIOR))
    for r in counts:
        precision[r.verdict] = (r.bad + 0.1) / (r.bad + good_weight * (r.n - r.bad) + 0.4)
    precision[(precision < LEAST) & np.isin(np.arange(len(precision)), [r.verdict for r in counts])] = 0.0
    share = {k: (r.bad, r.bad + good_weight * (r.n - r.bad)) for k, r in contexts.items()}
    plain = (share[-2][0] + 1.0) / (share[-2][1] + 1.0) if -2 in share else 1.0
    bad_quoted, n_quoted = share.get(-1, (0.0, 0.0))
    return automaton, precision, min(1.0, (bad_quoted / plain + PRIOR * QUOTED) / (n_quoted + PRIOR))


def text_score(hits: list[tuple[int, int, bool]], precision: np.ndarray, worth: float = QUOTED) -> float:
    """The chance that at least one hit is abuse."""
    clean = 1.0
    for i, (at, v, quoted) in enumerate(hits):
        near = (i > 0 and at - hits[i - 1][0] <= WINDOW) + (i + 1 < len(hits) and hits[i + 1][0] - at <= WINDOW)
        clean *= 1 - min(0.999, precision[v] * (1 + NEAR * near)) * (worth if quoted else 1.0)
    return 1 - clean * (1 - NO_HIT)


def score(docs: DataFrame, automaton: Automaton, precision: np.ndarray, worth: float = QUOTED, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for every row."""
    id_type = dict(docs.dtypes)[id_column]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = np.full(batch.num_rows, NO_HIT)
            for r, hits in hits_by_row(automaton, batch.column("text").to_pylist()):
                out[r] = text_score(hits, precision, worth)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(out)], [id_column, "score"])

    return docs.select(F.col(id_column), F.col(text).alias("text")).mapInArrow(scored, f"{id_column} {id_type}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs."""
    learned = learn(docs, labels, folds, held_out, id_column, text)
    return score(docs, *learned, id_column=id_column, text=text).select(id_column, (remainder(id_column, folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, learned from the labelled rows of all_docs."""
    automaton, precision, worth = learn(all_docs, labels, id_column=id_column, text=text)
    columns = docs.columns
    at = columns.index(text)
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            keep = np.ones(batch.num_rows, bool)
            for r, hits in hits_by_row(automaton, batch.column(at).to_pylist()):
                keep[r] = text_score(hits, precision, worth) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, schema)
