"""The conversation tree, spelling variants and packing against brute force and the library."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import packing, prefix_tree, queries, spelling

WORDS_JSON = public_tokenizers.path("word_bpe_49k.json")


# --- conversations


def plain_tree(built):
    """{(owner, depth): node} for {conv_id: [(role, text), ...]}."""
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)

    def below(key):
        stack, out = [key], []
        while stack:
            out.append(k := stack.pop())
            stack += children[k]
        return out

    out = {}
    for key, who in members.items():
        under = below(key)
        ends = sorted(c for c in who if len(built[c]) == len(key))
        out[min(who), len(key)] = (
            min(members[key[:-1]]) if key else None, len(who), len(children[key]), sum(not children[k] for k in under),
            sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in under if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def plain_turns(rows):
    """{conv_id: turns in order}; a tie goes by the digest of role and text."""
    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()

    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, digest(role or "", text or ""), (role or "", text or "")))
    return {c: [x[-1] for x in sorted(v)] for c, v in turns.items()}


def plain_branched(turns):
    built = {}
    for c, own in turns.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(base, [])[:h] + own[h:]
    return built


def tree_of(df):
    assert df.columns == [f.split()[0] for f in prefix_tree.NODES.split(", ")]
    rows = df.collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("depth", "pos", "n", "owner", "digest", "one", "x")})


def talks(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 200), n):
        for t in r.sample(range(30), r.choice((1, 2, 3, 5, 9, 12))):
            rows.append((c, None if t == 0 else t, r.choice(("user", "bot", None, "")), r.choice(("hi", "hi", "ho", "", None, "é" * 5, "long " * 3000))))
        if r.random() < 0.3:
            rows.append((c, 3, "user", "again"))
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(300)] + [(None, 1, "user", "nobody's")]
    return rows


def test_branched_tree(spark):
    rows = talks(1)
    got = tree_of(prefix_tree.branched_tree(conversations(spark, rows).repartition(7)))
    assert got == plain_tree(plain_branched(plain_turns(rows)))


def test_tree_of_turnless_conversations(spark):
    """Conversations whose first turns go and whose base does not exist are members of the root only."""
    rows = [(c, t, "user", "hello") for c in range(1, 40) if c % 5 for t in range(2)]
    built = plain_branched(plain_turns(rows))
    assert any(not v for v in built.values())
    assert tree_of(prefix_tree.branched_tree(conversations(spark, rows))) == plain_tree(built)
    alone = [(7, 1, "user", "x")]
    assert tree_of(prefix_tree.branched_tree(conversations(spark, alone))) == plain_tree(plain_branched(plain_turns(alone)))


def test_tree_of_no_conversations(spark):
    assert tree_of(prefix_tree.branched_tree(conversations(spark, []))) == {}
    assert tree_of(prefix_tree.conversation_tree(conversations(spark, [(None, 1, "a", "b")]))) == {}


def test_tall_tree_of_chains(spark):
    """Each conversation leaves the one before it a turn later, so that chains hang on chains 40 deep."""
    rows = [(c, t, "user", f"{min(t, c)}" if t <= c else f"own {c}") for c in range(40) for t in range(c + 3)]
    got = tree_of(prefix_tree.conversation_tree(conversations(spark, rows)))
    assert got == plain_tree(plain_turns(rows))


def test_members_in_many_blocks(spark):
    ends = spark.createDataFrame([(1, 2, m) for m in range(-50, 900)] + [(1, 3, 5), (2, 2, 7)], "conv_id long, depth long, member long").repartition(5)
    want = {(1, 2): ",".join(map(str, range(-50, 900))), (1, 3): "5", (2, 2): "7"}
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in prefix_tree.ends_digest(ends, 64).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_running_values_across_partitions(spark):
    rows = [(k, i, (k * 31 + i * 17) % 101 - 50) for k in range(3) for i in range(700 if k == 1 else 5)]
    df = spark.createDataFrame(rows, "k long, i long, v long").withColumn("w", F.col("v")).repartition(9)
    got = {(r.k, r.i): (r.s, r.x) for r in prefix_tree.running(df, "k", ["i"], {"v": "s"}, {"w": "x"}).collect()}
    want = {}
    for k, group in itertools.groupby(rows, lambda r: r[0]):
        s = x = 0
        for _, i, v in group:
            s, x = s + v, x ^ v
            want[k, i] = (s, x)
    assert got == want


# --- words


def plain_counts(docs, every=97, shortest=5, fewest=3):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % every == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            if len(low) >= shortest:
                n[low] += 1
    return {w: k for w, k in n.items() if k >= fewest}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form, w, n, len(others), counts[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


SOME = [None, "", " \n", "Straße ÀÉÿ naïve×÷ œuvre abcdef", "x" * 300 + " " + "é" * 200, "one,two;three3four_five", "ΑΒΓ кириллица \U0001f600word\U0001f600s Ābcdef", "same same same Same", "repeated words repeated words Repeated"]


def word_documents(seed, n=250):
    r = random.Random(seed)
    bases = ["colour", "behaviour", "organise", "señor", "grün" * 3, "abcde", "x" * 60]
    texts = list(SOME) * 3
    for _ in range(n):
        words = []
        for _ in range(r.randrange(40)):
            w = list(r.choice(bases[: r.randrange(1, len(bases) + 1)]))
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = r.choice(("", "a", "Z", "é"))
            words.append("".join(w))
        texts.append(r.choice((" ", ", ", "-")).join(words))
    return [(i if i % 11 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("every", [97, 3])
def test_word_counts(spark, every):
    docs = word_documents(5)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "id": F.lit(3)})
    assert {r.word: r.n for r in spelling.word_counts(df, every).collect()} == plain_counts(docs, every)


@pytest.mark.parametrize("bucket", [0, 1, 3, 32])
def test_near_words(spark, bucket):
    """Words of few letters, so that most keys are crowded and are lengthened to their end."""
    r = random.Random(bucket)
    words = {"".join(r.choice("abé") for _ in range(r.choice((1, 2, 5, 5, 6, 7, 8)))) for _ in range(260)} | {"", "long" * 50, "long" * 50 + "s", "lonk" + "long" * 49}
    df = spark.createDataFrame([(w, 1 + len(w)) for w in words], "word string, n long").repartition(5)
    pairs = [(r.word, r.other) for r in spelling.near_pairs(df, bucket).collect()]
    assert len(pairs) == len(set(map(frozenset, pairs)))
    assert set(map(frozenset, pairs)) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_crowded_keys_do_not_give_all_pairs(spark):
    """2,000 words with one beginning, none near another: the candidates stay near the number of words, not its square."""
    r = random.Random(9)
    words = [("same" * 3) + "".join(r.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(2000)]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    rows = spelling.halves(df)
    crowded = rows.where("not probe and b - a = 12 and key like '%samesamesame'").groupBy("key").count().agg(F.max("count")).first()[0]
    assert crowded == 2000
    second = spelling.lengthened(rows.where("b = 24 and a = 12")).where("not probe").groupBy("key").count().agg(F.max("count")).first()[0]
    assert second < 10
    assert spelling.near_pairs(df).count() == sum(near(a, b) for a, b in itertools.combinations(sorted(set(words)), 2))


def test_forms_and_roots(spark):
    counts = {"aaaaa": 100, "aaaab": 50, "aaabb": 20, "aabbb": 9, "aabbbb": 9, "zaaaa": 100, "bbbbb": 1, "ccccc": 3}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.with_roots(spelling.forms(df)).collect()}
    assert got == plain_variants(counts)
    assert got["aabbb"] == ("aaabb", "aaaaa", 9, 2, 20) and got["aaaaa"][0] is None and got["ccccc"] == (None, "ccccc", 3, 0, None)


def test_spelling_variants(spark):
    docs = word_documents(8)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("root", F.lit(0))
    found = spelling.spelling_variants(df, bucket=2)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r)[1:] for r in found.collect()} == plain_variants(plain_counts(docs))
    assert spelling.spelling_variants(df.limit(0)).count() == 0


# --- windows

TEXTS = [None, "", " \n\t ", "one", "It's NAÏVE ﬁ Å Å <|endoftext|> x<|startoftext|>y <|endof", "Ünï ▁code \U0001f600 日本語 \x00\x07\x1c\x85 end", "ΟΔΟΣ Σ", "word other. " * 30_000, "ab" * 4000, "日本" * 3000, "same text", "same text"]


def packed(spark, texts, **options):
    df = spark.createDataFrame([(i if i % 13 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "start", "offset", "sequence_id")})
    return packing.pack(df.coalesce(1), WORDS_JSON, **options).collect()


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS_JSON)


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize(("length", "most_open"), [(4096, 512), (64, 6), (64, 2)])
def test_packing_is_exact(spark, length, most_open):
    r = random.Random(length)
    texts = TEXTS + [" ".join(r.choices(["alpha", "beta", "don't", "x1y2", "ÄÖ"], k=r.choice((1, 4, 12, 30, 70)))) for _ in range(300)]
    texts = [t if t is None or length > 100 else t[:2000] for t in texts]
    rows = packed(spark, texts, length=length, most_open=most_open)
    by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        by_document[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    for i, t in enumerate(texts):
        if i % 13:
            want = library_ids(t)
            pieces = sorted(by_document[i], key=lambda x: x.start)
            assert [x.start for x in pieces] == [0, *itertools.accumulate(len(x.ids) // 4 for x in pieces)][:-1]
            assert np.frombuffer(b"".join(bytes(x.ids) for x in pieces), "<u4").tolist() == want
            assert {x.doc_tokens for x in pieces} == {len(want)}
    sizes = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda x: x.offset)
        assert [x.offset for x in pieces] == [0, *itertools.accumulate(len(x.ids) // 4 for x in pieces)][:-1]
        sizes.append(sum(len(x.ids) // 4 for x in pieces))
    assert max(sizes) <= length and all(s == length or s & (s - 1) == 0 for s in sizes)  # nothing is padded
    assert sum(sizes) == sum(len(library_ids(t)) for t in texts)
    if most_open == 512:
        cuts = len(rows) - len(texts)
        assert cuts < 60


def test_documents_are_placed_at_the_least_sum_of_squares():
    r = random.Random(3)
    levels = packing.Levels(40, 10_000)
    for k in range(600):
        size = r.choice((3, 7, 11, 19, 20, 21, 39, r.randrange(1, 40)))

        def squares(level, size=size):
            counts = levels.counts.copy()
            counts[level] -= level > 0
            counts[level + size] += level + size < 40
            return int((counts**2).sum())

        options = [0, *(int(h) for h in np.flatnonzero(levels.counts) if h + size <= 40)]
        assert squares(levels.choose(size)) == min(map(squares, options))
        levels.place(packing.Piece(k, 0, np.zeros(size, "<u4"), size))
        assert levels.open == levels.counts.sum() == sum(map(len, levels.windows.values()))
        assert all(sum(len(p.ids) for p in w) == h for h, found in levels.windows.items() for w in found)


def test_open_windows_are_bounded():
    levels = packing.Levels(100, 8)
    closed = []
    for k in range(500):
        closed += levels.place(packing.Piece(k, 0, np.zeros(51, "<u4"), 51))
        assert levels.open <= 8
    closed += levels.finish()
    assert sum(len(p.ids) for w in closed for p in w) == 500 * 51 and not levels.open


def test_sequences(spark):
    df = spark.createDataFrame([(i, "some text here " * i) for i in range(60)], "doc_id long, text string")
    rows = packing.sequences(packing.pack(df, WORDS_JSON, length=64)).collect()
    assert sum(x.n_tokens for x in rows) == sum(len(library_ids("some text here " * i)) for i in range(60))
    assert all(len(x.ids) == 4 * x.n_tokens and sum(p.length for p in x.pieces) == x.n_tokens for x in rows)
    assert packing.pack(df.limit(0), WORDS_JSON).count() == 0


def test_packing_query(spark):
    """The registered query on a whole table, piece by piece against the library's ids."""
    data = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op13_packing"](spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library_ids(texts[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
    covered = collections.Counter()
    for r in rows:
        covered[r.doc_id] += r.length
    assert covered == {i: len(library_ids(t)) for i, t in texts.items()}
