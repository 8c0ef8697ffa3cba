"""The whole pipeline on a small table, each stage against a plain version of it."""

import hashlib
import math
import os
import random
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tokenloom.llm import quality, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels with nulls, empty and repeated texts, near copies, toxic and odd documents."""
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghiklmnoprstu", k=r.randrange(2, 9))) for _ in range(500)]
    texts = [None, "", " \n\t ", "few words", *[" ".join(r.choices(words, k=r.randrange(15, 80))) for _ in range(160)]]
    texts += [texts[30], texts[31], texts[31]]  # exact copies
    for i in range(40, 60):  # near copies
        w = texts[i].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for i in range(40):  # toxic ones
        w = r.choices(words, k=30)
        w[r.randrange(30)] = r.choice(["vilewretch", "grottyfool"])
        texts.append(" ".join(w))
    texts += ["### $$$ " * 20 + " ".join(r.choices(words, k=30)), "SHOUTED " * 3 + " ".join(r.choices(words, k=40)).upper(), "same five words again here " * 30]
    texts.append(" ".join(random.Random(8).choices([f"{a}{b}" for a in words for b in words[:40]], k=30_000)))  # a very long one
    toxic = {i for i, t in enumerate(texts) if t and ("vilewretch" in t or "grottyfool" in t)}
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["web", "web", "book", None]), len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts)) if i % 9], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_brute_force(spark, folder):
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {v.doc_id: v for v in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, folder)
    ratios = {v.doc_id: v for v in quality.with_ratios(quality.with_features(docs)).collect()}
    want = {i for i, k in brute.quality_kept([(v.doc_id, v.lang, v.source) for v in rows.values()], ratios).items() if k}
    got = {v.doc_id: v for v in kept.collect()}
    assert set(got) == want and all(got[i] == rows[i] for i in got)

    clean = stages["toxicity"](spark, kept, folder)
    automaton, precision, worth = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert automaton.terms == ["grottyfool", "vilewretch"]
    want = {i for i in want if brute.plain_score(rows[i].text, automaton.terms, precision, worth) < 0.5}
    assert {v.doc_id for v in clean.collect()} == want and not any("vilewretch" in rows[i].text for i in want)

    single = stages["n-gram Jaccard join"](spark, clean, folder)
    component = brute.jaccard_components([(i, rows[i].text) for i in want])
    want = {i for i in want if component[i][1] == i}
    assert {v.doc_id for v in single.collect()} == want

    mixed = stages["mixing sources"](spark, single, folder)
    sizes = {}
    for i in want:
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + len(rows[i].text)
    total, weights = sum(sizes.values()), sum(math.sqrt(x) for x in sizes.values())
    copies = {}
    for i in want:
        size = sizes[rows[i].source]
        rate = math.sqrt(size) / weights * total / size
        u = int(hashlib.md5(f"mix:count:{i}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        n, term = 0, math.exp(-rate)
        seen = term
        while seen <= u:
            n += 1
            term *= rate / n
            seen += term
        if n:
            copies[i] = n
    got = mixed.groupBy("doc_id").count().collect()
    assert {v.doc_id: v["count"] for v in got} == copies and mixed.columns == docs.columns

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = stages["SentencePiece"](spark, mixed, folder).collect()
    assert len(ids) == sum(copies.values()) and all(v.ids == model.encode(rows[v.doc_id].text) and v.round_trip for v in ids)


def test_stages_take_any_rows(spark, folder):
    """Null ids and texts, repeated rows and columns with clashing names; every stage but the last keeps the columns."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(7) for c in ("kept", "id", "node", "score", "count", "rate", "copy_no", "n_words", "size", "ratio")})
    odd = docs.limit(60).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    docs = odd.unionByName(odd.where("doc_id is not null")).unionByName(docs.withColumn("text", F.lit(None).cast("string")).limit(5))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        if name == "mixing sources":
            assert set(docs.columns) == set(before) - {"copy_no"}
        elif name != "SentencePiece":
            assert docs.columns == before and rows
