"""The methods themselves against plain versions: distances, scores, verdicts, recall, and memory of long words."""

import collections
import math
import os
import random
import re
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tokenloom.llm import binary_output, components, hnsw, langid, mixing, quality, sentencepiece_codec, token_count, toxicity
from tokenloom.llm.common import remainder

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# language id


def grams(text):
    chars = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    found = collections.Counter()
    for i, c in enumerate(chars):
        if c != " ":
            found[c] += 1
        if i + 1 < len(chars) and (c != " " or chars[i + 1] != " "):
            found[c + chars[i + 1]] += 1
        if i + 2 < len(chars) and chars[i + 1] != " ":
            found[chars[i : i + 3]] += 1
    return found


def profile(counts):
    """The n-grams, most frequent first; ties by their code points, shorter ones first."""
    return sorted(counts, key=lambda g: (-counts[g], [ord(c) for c in g.rjust(3, chr(0))]))[: langid.PROFILE]


def test_language_distance_is_brute_force(spark):
    r = random.Random(2)
    alphabets = {"aa": "abcde", "bb": "bcdef", "cc": "cdefgé", "dd": "日本語の", "ee": "abcde"}  # ee is like aa
    make = lambda a, n: " ".join("".join(r.choices(a, k=r.randrange(1, 7))) for _ in range(n))
    rows = [(i, None if i % 17 == 0 else make(alphabets[lang], r.randrange(0, 30)), lang if i % 7 else None) for i in range(260) for lang in [sorted(alphabets)[i % 5]]]
    rows += [(260, "123 45 -", "aa"), (261, "", "bb"), (262, "x" * 5000 + " " + make("abcdef", 4000), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {v.doc_id: (v.lang_pred, v.score, v.held_out) for v in langid.language_id(docs).collect()}
    held = {v.doc_id for v in docs.where(remainder("doc_id", 4) == 2).collect()}
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if i not in held and lang is not None:
            counts[lang] += grams(t)
    profiles = {lang: {g: k for k, g in enumerate(profile(c))} for lang, c in sorted(counts.items()) if c}
    for i, t, _ in rows:
        own = profile(grams(t))
        want = ("und", 0.0)
        if own:
            far = {lang: sum(abs(p[g] - k) if g in p else langid.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
            best = min(far, key=lambda x: (far[x], x))
            least, second = sorted(far.values())[:2]
            want = (best, second / max(least + second, 1e-9))
        assert got[i][:2] == (want[0], pytest.approx(want[1])), i
        assert got[i][2] == (i in held)


def test_language_parts_change_nothing(monkeypatch):
    r = random.Random(7)
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randrange(1, 6))) for _ in range(r.randrange(0, 40))) for _ in range(90)]
    found = langid.top_ngrams(*langid.ngram_counts(texts), langid.PROFILE)
    index = langid.inverted([found[1][found[0] == k].tolist() for k in range(0, 90, 3)])
    whole = langid.nearest(index, 90, *found, 30)
    monkeypatch.setattr(langid, "ENTRIES", 500)
    assert all((a == b).all() for a, b in zip(whole, langid.nearest(index, 90, *found, 30), strict=True))


def test_language_ties_and_many_languages(spark):
    """Equal profiles: the first language in alphabetical order; no number of languages is too many."""
    rows = [(i, f"{chr(0x4E00 + i % 900) * 3} {chr(0x4E00 + i % 900) * 2}", f"l{i % 900:03d}") for i in range(3600)] + [(4000 + i, "abc abd", lang) for i, lang in enumerate(["zz", "yy"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {v.doc_id: v.lang_pred for v in langid.language_id(docs).collect()}
    assert all(got[4000 + i] == "yy" for i in range(16))
    assert sum(got[i] == lang for i, _, lang in rows[:3600]) >= 0.95 * 3600


# toxicity


def test_toxicity_score_is_brute_force(spark):
    r = random.Random(5)
    terms = ["grotty", "vile", "wretched"]
    filler = ["said", "the", "garden", '"yes"', "vilest", "grotti", "word", "x", "日本", "stone,", "(moss)"]
    texts = [None, "", "  ", "vile", "VILE!", "“grottyy”", "he said vile", "wretchd wretched"] + [" ".join(r.choices(filler + terms + ["wreched", "“vile”", "grotty."], k=r.randrange(1, 40))) for _ in range(150)] + ["stone " * 30_000 + "vile"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"score": F.lit(1), "toxic": F.lit(1)})
    precision = np.asarray([0.9, 0.4, 0.7, 0.0, 0.95, 0.6])
    got = {v.doc_id: v.score for v in toxicity.score(docs, toxicity.Automaton(terms), precision, 0.4).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute.plain_score(t, terms, precision, 0.4)), t


def test_toxicity_learns_terms_and_quotations(spark):
    """All terms that stand out are learned, however many; hits in quotations of clean texts lose their worth, in toxic ones they keep it."""
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}qword{i % 26}" for i in range(600)]
    r = random.Random(1)
    toxic = [" ".join([f"u{i}a", *r.sample(words, 60), f"u{i}b"]) for i in range(300)]
    clean = [f"c{i}a c{i}b c{i}c c{i}d" for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    automaton, _, _ = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") < 300).cast("int").alias("toxic")))
    assert len(automaton.terms) == 600
    worth = []
    for said in (0, 1):
        quoted = [f"q{i}a q{i}b “aaqword0” q{i}c q{i}d" for i in range(30)]
        rows = [(i, t, 1) for i, t in enumerate(f"t{i}a t{i}b t{i}c aaqword0 t{i}d" for i in range(200))] + [(5000 + i, t, said) for i, t in enumerate(quoted)] + [(1000 + i, t, 0) for i, t in enumerate(clean)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        worth.append(toxicity.learn(docs, docs.select("doc_id", "toxic"))[2])
    assert worth[0] < 0.1 and worth[1] > 0.9


# quality


def test_quality_verdicts_are_brute_force(spark):
    r = random.Random(12)
    rows = []
    for i in range(400):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["web", "web", "book", None, f"rare{i % 9}"])
        k = r.choice([3, 12, 30, 60])
        words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9 if lang == "en" else 13))) for _ in range(k)]
        for j in range(k):
            if r.random() < 0.03:
                words[j] = r.choice(["###", words[j - 1], words[j].upper(), "$%&|<>"])
        if r.random() < 0.05:
            words = [w.upper() for w in words]
        rows.append((i, None if i % 50 == 0 else r.choice([" ", "\n"]).join(words), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ratios = {v.doc_id: v for v in quality.with_ratios(quality.with_features(docs)).collect()}
    got = {v.doc_id: v.kept for v in quality.quality_verdicts(docs).collect()}

    want = brute.quality_kept([(i, lang, source) for i, _, lang, source in rows], ratios)
    assert got == want
    assert 0.5 < sum(got.values()) / len(got) < 1
    assert {v.doc_id for v in quality.quality_filter(docs).collect()} == {i for i, k in got.items() if k}


# embeddings


@pytest.mark.parametrize("dim", [24, 256])
def test_embedding_recall_on_planted_links(spark, dim):
    """Links just above the threshold, in several shards of a label."""
    r = np.random.default_rng(dim)
    base = r.normal(size=(1500, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    extra = hnsw.planted(base.astype(np.float32), 0.98, 1500).astype(float) * 3.0
    x = np.concatenate([base, extra])
    rows = [(i, "a", v.tolist()) for i, v in enumerate(x)]
    got = {v.vec_id: v.n_links for v in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"), shard_rows=800).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    assert want.sum() >= 3000 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum()


def test_audits_widen_beams():
    """A beam too narrow for the data is found out by the planted links and widened."""
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6))
    graph, widths = hnsw.Graph(hnsw.unit(x)), []
    search = graph.within
    graph.within = lambda q, least, beam: widths.append(beam) or ((np.zeros(0, int), np.zeros(0, int)) if beam < 256 else search(q, least, beam))
    hnsw.pairs_in(graph, x, x, 0.98, True)
    assert widths[0] == hnsw.BEAM and widths[-1] >= 256


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed, monkeypatch):
    monkeypatch.setattr(components, "LINKS", 40)
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000, 1001 + i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2100)] + [(5, 5)]
    r.shuffle(links)
    got = {v.node: v.component for v in components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# SentencePiece


def test_long_words_take_memory_in_proportion():
    import sentencepiece

    codec, model = sentencepiece_codec.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    word = "".join(random.Random(3).choices("abcdefghij日本語のé", k=100_000))
    tracemalloc.start()
    ids = codec.encode([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert ids[:20_000].tolist() == model.encode(word[:80_000])[:20_000]
    assert codec.decode(ids) == word
    short = word[:3000]
    assert codec.encode([short])[0].tolist() == model.encode(short)


def test_unigram_forward_scores_are_viterbi():
    """The same pieces with scores of a unigram model: the best sum of scores over all ways to cut a word."""
    codec = sentencepiece_codec.Codec(PIECES)
    r = random.Random(4)
    pieces = [*"abcd", "ab", "bc", "cd", "abc", "bcd", "dd", "aab", sentencepiece_codec.MARK, sentencepiece_codec.MARK + "a"]
    codec.bpe, codec.pieces = False, {p: codec.pieces.get(p, i + 300) for i, p in enumerate(pieces)}
    codec.score = {p: -r.uniform(0.5, 3) * (1 + len(p) / 3) for p in pieces}
    codec.least, codec.lengths = min(codec.score.values()), sentencepiece_codec.Lengths(codec.pieces)
    names = {i: p for p, i in codec.pieces.items()}
    words = sorted({sentencepiece_codec.MARK + "".join(r.choices("abcdé", k=r.randrange(1, 12))) for _ in range(300)})

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for i in range(1, len(word) + 1):
            top[i] = top[i - 1] + codec.least - 10
            for p in pieces:
                if word[:i].endswith(p):
                    top[i] = max(top[i], top[i - len(p)] + codec.score[p])
        return top[-1]

    for word, packed in zip(words, codec.encode_words(words), strict=True):
        ids = np.frombuffer(packed, np.int32).tolist()
        known = [names[i] for i in ids if i in names]
        unknown = word.count("é")
        assert sum(codec.score[p] for p in known) + unknown * (codec.least - 10) == pytest.approx(best(word))
        assert "".join(known) == word.replace("é", "")


# mixing


@pytest.mark.parametrize("rate", [0.0, 0.3, 7.5, 63.9, 500.0, 40_000.0, 1e6])
def test_poisson_inverse(spark, rate):
    v = mixing.poisson_steps(spark.createDataFrame([("s", rate)], "source string, rate double")).first()
    assert len(v.steps) <= 25 * math.sqrt(rate) + 70
    log = lambda k: k * math.log(rate) - rate - math.lgamma(k + 1) if rate else (0.0 if k == 0 else -math.inf)
    total = 0.0
    for k in range(v.first, v.first + len(v.steps)):
        total += math.exp(log(k))
        assert v.steps[k - v.first] == pytest.approx(total, rel=1e-6, abs=1e-9)
    assert v.steps[-1] == pytest.approx(1.0, abs=1e-8)


# shards and counts


def test_shards_are_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words here " * i) for i in range(60)], "doc_id long, text string")
    out = str(tmp_path / "s")
    rows = binary_output.token_shards(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), out, length=64, shard_rows=8)
    n = rows.count()
    when = {f: os.stat(f"{out}/{f}").st_mtime_ns for f in os.listdir(out)}
    assert rows.count() == n and when == {f: os.stat(f"{out}/{f}").st_mtime_ns for f in os.listdir(out)}
    assert not [f for f in when if f.startswith("_writing")]
    with pytest.raises(ValueError, match="no file system"):
        binary_output.file_system("nostore:/x")


def test_token_cache_setting(spark, tmp_path):
    spark.conf.set(token_count.CACHE_SETTING, str(tmp_path / "c"))
    try:
        docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None)], "doc_id long, text string")
        for _ in range(2):
            assert token_count.count_tokens(docs, PIECES).count() == 3
        assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    finally:
        spark.conf.unset(token_count.CACHE_SETTING)


def test_mixing_draws_one_number_a_document(spark):
    """The MD5 behind a document's number stands outside the lambda over the distribution's steps."""
    docs = spark.createDataFrame([(i, "x" * i, "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs)._jdf.queryExecution().optimizedPlan().toString()
    steps = [plan[m.end() : plan.index("<= lambda", m.end())] for m in re.finditer(r"filter\(__steps[^,]*, lambdafunction\(", plan)]
    assert steps and all("md5" not in s for s in steps)
