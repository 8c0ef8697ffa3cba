import math
import os
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tokenloom.llm import binary_output, hnsw, html_extract, jaccard_join, langid, mixing, quality, sentencepiece_codec, token_count, toxicity  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LONG = "word other. " * 40_000
TEXTS = [None, "", " \n\t ", "one", "a b c d", "A  b\nC d e", "Ünï ▁code \U0001f600 日本語 \x00\x07 end", LONG, "same text here for all of us", "same text here for all of us", "### $$ | < > & %% ** ##", "line one\nline two\nline one\n\nline one"]


def documents(spark, texts=None, **columns):
    """documents with clashing extra columns."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(7) for c in ("kept", "n_words", "id", "node", "component", "score", "rate", "count", "label", "batch", "copy_no")})


def near_copies(seed, n=150):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(words, k=30))
    bases = [[r.choice(words) for _ in range(r.choice((3, 5, 6, 9, 20, 60, 150)))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            w[r.randrange(len(w))] = r.choice(words)
        text = " ".join(w)
        out.append(text.upper() if r.random() < 0.2 else f"{passage} {text}" if r.random() < 0.4 else text)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    texts = near_copies(seed) + TEXTS
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(documents(spark, texts)).collect()}
    assert got == brute.jaccard_components(list(enumerate(texts)))


def test_jaccard_frequent_passage(spark, monkeypatch):
    """Shingles that are left out of fine sketches change no result."""
    monkeypatch.setattr(jaccard_join, "COMMON", 3)
    texts = near_copies(3, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(documents(spark, texts)).collect()}
    assert got == brute.jaccard_components(list(enumerate(texts)))


def test_jaccard_keeps_one_of_each(spark):
    docs = documents(spark)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11]
    null = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard_join.one_of_each(null).count() == 3
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_bit_sketches_are_lower_bounds():
    r = np.random.default_rng(5)
    for a, b in ((10, 40), (100, 90), (700, 5000)):
        x, y = (np.unique(r.integers(0, 2 * max(a, b), n)).astype(np.uint64) for n in (a, b))
        sx, sy = (jaccard_join.bit_sketches(v, np.asarray([0, len(v)]))[0] for v in (x, y))
        assert jaccard_join.differ(sx, sy) <= len(np.setxor1d(x, y))


def test_embeddings_of_any_size(spark):
    """Equal and proportional vectors link, however small or large their components are."""
    tiny, huge = [1e-170, 2e-170], [1e200, 2e200]
    rows = [(0, tiny), (1, tiny), (2, huge), (3, huge), (4, [1.0, 2.0]), (5, [-1.0, 2.0]), (6, [0.0, 0.0]), (7, [5e-324, 0.0]), (8, [1e308, 0.0]), (9, [1e308, 1e308])]
    got = hnsw.near_duplicates(spark.createDataFrame([(i, "a", x) for i, x in rows], "vec_id long, label string, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7), 9: (0, 9)}


def test_embedding_near_duplicates(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    x = base[r.integers(0, 60, 400)] + r.normal(size=(400, 16)) * 0.04
    x[5] = x[6]
    rows = [(i, str(i % 2), v.tolist()) for i, v in enumerate(x)]
    bad = [(400, "0", None), (401, "0", []), (402, "0", [0.0] * 16), (403, "0", [float("nan")] * 16), (404, None, x[0].tolist()), (405, "0", [None] + x[0].tolist()[1:]), (406, "0", x[0].tolist()[:8])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, label string, embedding array<double>").withColumn("id", F.lit(1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2)
    np.fill_diagonal(near, False)
    want = brute.components(range(407), [(a, b) for a, b in zip(*np.nonzero(near), strict=True)])
    for shard_rows in (64, 16_384):
        got = {v.vec_id: v for v in hnsw.near_duplicates(vectors, shard_rows=shard_rows).collect()}
        assert {i: v.n_links for i, v in got.items()} == {i: int(near[i].sum()) if i < 400 else 0 for i in range(407)}
        assert {i: v.component_id for i, v in got.items()} == want
        assert all(v.kept == (v.component_id == i) for i, v in got.items())
    assert hnsw.near_duplicates(vectors.limit(0)).count() == 0


def test_quality_base_counts(spark):
    r = random.Random(4)
    texts = TEXTS + [" ".join(r.choices(["a", "bb", "c#", "d\n", "é"], k=r.randrange(60))) for _ in range(80)]
    for v in quality.quality_verdicts(documents(spark, texts)).collect():
        n = brute.base_counts(texts[v.doc_id])
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == n
        assert v.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (v.base_failed and v.kept)


def test_quality_thresholds(spark):
    """The quantiles of a sketch are within GAMMA of the true ones, and an odd document goes."""
    texts = [" ".join(f"word{i}x{j}" for j in range(20 + i % 9)) for i in range(120)] + [" ".join(f"w{j} #$%" for j in range(30))]
    docs = documents(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    ratios = quality.with_ratios(quality.with_features(docs))
    q = quality.quantiles(quality.sketches(ratios), ["lang", "source"]).where("ratio = 'mean_word'").first()
    values = sorted(r.mean_word for r in ratios.collect())
    for share, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        assert abs(math.log(q[name] / values[math.ceil(share * len(values)) - 1])) <= math.log(quality.GAMMA)
    assert {r.doc_id for r in quality.quality_verdicts(docs).where("not kept").collect()} == {120}
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == 120
    assert quality.quality_filter(docs.limit(0)).count() == 0


def test_token_counts(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = str(tmp_path / "cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(documents(spark), PIECES, cache).collect()}
    want = {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(TEXTS)}
    assert got == {i: (a, b, b > 4096) for i, (a, b) in want.items()}
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for t in TEXTS})
    token_count.count_tokens(documents(spark, [*TEXTS, "new one"]), PIECES, cache).collect()
    assert spark.read.parquet(cache).count() == before + 1
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(documents(spark), path).collect()}
    assert got == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert token_count.count_tokens(documents(spark).limit(0), PIECES).count() == 0


def test_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(6)
    texts = TEXTS + ["".join(r.choices("abcdehlorst  '.,1é▁ñ\n", k=r.randrange(80))) for _ in range(300)]
    encoded = sentencepiece_codec.encode_column(documents(spark, texts), PIECES)
    rows = {v.doc_id: v for v in encoded.collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == model.encode(t or "") and rows[i].n_tokens == len(rows[i].ids)
    back = {v.doc_id: v.text for v in sentencepiece_codec.decode_column(encoded, PIECES).collect()}
    assert all(back[i] == model.decode(rows[i].ids) for i in back)
    assert all((back[i] == (t or "")) == rows[i].round_trip for i, t in enumerate(texts))
    assert sentencepiece_codec.encode_column(documents(spark).limit(0), PIECES).count() == 0


def test_automaton():
    r = random.Random(8)
    terms = ["badword", "vile", "nasty", "mean*", "crude", "crudest"]
    automaton = toxicity.Automaton(terms)
    words = ["".join(r.choices("abdemnorstuvyw", k=r.randrange(1, 9))) for _ in range(300)]
    for t in terms:
        for _ in range(80):
            w = list(t.rstrip("*"))
            w[r.randrange(len(w))] = r.choice(["", "x", "ab", w[0]])
            words.append("".join(w))
    words = [w for w in words if w]
    chars, starts, ends, row = toxicity.words_of(words)
    found, _ = automaton.match(chars, starts, ends)
    near = lambda w, t: w == t or len(t) >= toxicity.FUZZY_LENGTH and brute.distance(w, t) <= 1
    want = [i for i, w in enumerate(words) if any(w.startswith(t[:-1]) if t.endswith("*") else near(w, t) for t in terms)]
    assert row[found].tolist() == want


@needs_data
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels)
    assert scored.where("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    both = {r.toxic: (r.hit, r.n) for r in scored.where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("hit"), F.count("*").alias("n")).collect()}
    assert both[1][0] >= 0.6 * both[1][1] and both[0][0] <= 0.03 * both[0][1]
    edge = toxicity.toxicity(documents(spark), labels.limit(0)).collect()
    assert len(edge) == len(TEXTS) and not any(r.predicted for r in edge)
    assert toxicity.toxicity_filter(documents(spark), docs, labels).columns == documents(spark).columns


@needs_data
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and lang is not null and n_chars > 100").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)
    edge = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(documents(spark)).collect()}
    assert edge[0] == edge[1] == edge[2] == edge[10] == ("und", 0.0) and edge[7][0] == "en"
    assert langid.language_id(docs.limit(0)).count() == 0


def test_html_extraction(spark):
    page = '<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-banner">We use cookies here</div><article><h1>Big &amp; small</h1><p>First  paragraph of the story has\n many words to read, and <b>more</b> words.</p><p>Second paragraph of the story &eacute; with enough words to be read.</p></article><div id="comments"><p>I think that this is a nice story to read today.</p></div><footer>Contact</footer></body></html>'
    want = "Big & small\n\nFirst paragraph of the story has many words to read, and more words.\n\nSecond paragraph of the story é with enough words to be read."
    rows = [(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<p>" + "long words here. " * 50_000 + "</p>"), (4, "u", "<div <p>< & <!-- never ends"), (5, "u", page)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[0].text == want == got[5].text and got[0].n_chars == len(want)
    assert got[1].text == got[2].text == "" and got[3].n_chars == 17 * 50_000 - 1 and len(got) == 6


def test_mixing(spark):
    r = random.Random(9)
    texts = TEXTS + [f"text {i} " * r.randrange(1, 9) for i in range(300)]
    docs = documents(spark, texts)
    rates = {v.source: v.rate for v in mixing.source_rates(docs).collect()}
    got = {}
    mixed = mixing.mix_sources(docs)
    for v in mixed.collect():
        got.setdefault(v.doc_id, []).append(v.copy_no)
    import hashlib

    for i in range(len(texts)):
        rate = rates[f"s{i % 3}" if i % 5 else None]
        u = int(hashlib.md5(f"mix:count:{i}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        n, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        assert sorted(got.get(i, [])) == list(range(1, n + 1))
    assert set(mixed.columns) == set(docs.columns) | {"shuffle_key"}
    only = mixing.mix_sources(docs, {"s0": 1.0}, epochs=0.5)
    assert {v.source for v in only.select("source").collect()} == {"s0"}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_feistel():
    for n in (1, 2, 7, 64, 1000):
        x = np.arange(n)
        y = binary_output.feistel(x, n, 5)
        assert sorted(y.tolist()) == x.tolist() and (binary_output.feistel(y, n, 5, inverse=True) == x).all()


def test_token_shards(spark, tmp_path):
    out = str(tmp_path / "shards")
    docs = documents(spark).repartition(3)
    rows = sorted(binary_output.token_shards(docs, RANKS, out, length=64, shard_rows=50).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    model = binary_output.encoding(RANKS)
    want = {i: [*model.encode_ordinary(t or ""), binary_output.layout(RANKS)[0]] for i, t in enumerate(TEXTS)}
    read = list(binary_output.read_sequences(out, 0, len(rows), 64, 50))
    assert len(read) == len(rows)
    assert all((a == b).all() for a, b in zip(binary_output.read_sequences(out, 57, 30, 64, 50), read[57:87], strict=True))
    tokens = {r.slot: r.tokens for r in binary_output.read_shards(spark, out, 64, 50).collect()}
    assert all(tokens[i] == x.tolist() for i, x in enumerate(read))
    counted = {i: 0 for i in want}
    for r, data in zip(rows, read, strict=True):
        assert r.byte_offset == r.slot % 50 * 128 and r.shard == r.slot // 50
        for i, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens], strict=True):
            counted[i] += b - a
            if b - a == len(want[i]):
                assert data[a:b].tolist() == want[i]
    assert counted == {i: len(x) for i, x in want.items()}
    assert binary_output.token_shards(docs.limit(0), RANKS, str(tmp_path / "none")).count() == 0


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    small = DATA.replace("sf0.01", "sf0.001")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, small)
        assert name == "SentencePiece" or docs.columns == columns
        assert name == "mixing sources" or docs.count() <= before
    assert docs.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_jaccard_prefixes_lose_no_pair(spark):
    """Each similar pair shares a token under the position test, whichever shingles are frequent; parity cells had this by chance only."""
    texts = near_copies(4, 90)
    docs = documents(spark, texts).select(F.col("doc_id").alias("id"), "text")
    node = {r.id: r.node for r in jaccard_join.document_nodes(docs).collect()}
    sets = [brute.shingles(t) for t in texts]
    prefix = jaccard_join.prefixes(docs, sum(map(len, sets)))
    left, right = (prefix.select("token", *(F.col(c).alias(n) for c, n in zip(("node", "n_shingles", "pos"), names, strict=True))) for names in (("a", "m", "i"), ("b", "n", "j")))
    found = {(r.a, r.b) for r in left.join(right, "token").where(jaccard_join.may_be_similar("m", "i", "n", "j")).select("a", "b").distinct().collect()}
    similar = [(x, y) for x in range(90) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]) and node[x] != node[y]]
    assert similar and all((node[x], node[y]) in found for x, y in similar)
    front = {(r.token, r.node) for r in prefix.where(jaccard_join.in_front("n_shingles", "pos")).select("token", "node").collect()}
    for r in left.join(right, "token").where(jaccard_join.may_be_similar("m", "i", "n", "j")).collect():
        assert (r.token, r.a) in front or (r.token, r.b) in front


@pytest.mark.parametrize("clean", [500, 2500])
def test_toxicity_unseen_misspelling(spark, clean):
    """A misspelling that the sample lacks counts the same in a small and in a large sample."""
    texts = [f"t{i}a t{i}b t{i}c vilebad t{i}d t{i}e" for i in range(40)] + [f"c{i}a c{i}b c{i}c c{i}d c{i}e" for i in range(clean)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    automaton, precision, _ = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") < 40).cast("int").alias("toxic")))
    assert automaton.terms == ["vilebad"] and precision[1] == pytest.approx(0.6)


@pytest.mark.parametrize("odd", ["<button>", "<select>", "<object data=x>", "<svg viewBox='0 0 1 1'/>", "<iframe src=x />", "<button-group>", "<video-player>", "<title-bar>", "<svg-icon></svg-icon>"])
def test_html_missing_end_tags(odd):
    main = "Main text of the page with enough words in it to be read as a paragraph of the story."
    assert html_extract.main_text(f"<html><head><meta charset=x><body><article>{odd}<p>{main}</p></article>") == main
    assert html_extract.main_text(f"<html><head><title>T</title></head><body><svg><text>no</text></svg><article><button>Buy</button><p>{main}</p></article>") == main


def test_shards_of_wide_ids(spark, tmp_path):
    """A vocabulary with an id beyond 65,535: ids of four bytes, and the first free id as end."""
    import base64

    ranks = tmp_path / "ranks.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(bytes([k])) + b" %d\n" % k for k in range(256)) + base64.b64encode(b"ab") + b" 70000\n")
    assert binary_output.layout(str(ranks)) == (70_001, "<u4") and binary_output.layout(RANKS) == (50_256, "<u2")
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "cab")], "doc_id long, text string").coalesce(1)
    out = f"{tmp_path}/shards"
    rows = binary_output.materialise(docs, str(ranks), out, length=4, shard_rows=2).collect()
    back = [x.tolist() for x in binary_output.read_sequences(out, 0, len(rows), 4, 2, "<u4")]
    assert sorted(back) == sorted([[70_000, 99, 70_001, 70_001], [99, 70_000, 70_001, 70_001]])
    assert sorted(r.tokens for r in binary_output.read_shards(spark, out, 4, 2, "<u4").collect()) == sorted(back)
