"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per document, ratios are computed from the whole text. Per language and source, each ratio is summarised by a
mergeable quantile sketch: counts of logarithmic buckets of relative width GAMMA, which add up over tasks and groups
and give every quantile within GAMMA. A group's sketch is merged with that of its language, weighted like PRIOR_DOCS
documents, and a language's with that of the whole corpus in the same way, so that a small group's limits are near those of its
language and a large group's are its own. The limits are the median plus SPREAD times the distance to the upper (or
lower) quartile, at least SLACK away from the median. Limits and ratios are joined,
and documents outside them, or failing the fixed base rules, are rejected.

Defined cases: null counts as a text without words; texts without words fail the base rules and stay out of the
sketches; null language or source is a group of its own; equal rows get equal verdicts; very long texts
are measured whole; an empty table gives an empty
result; input columns named like the results are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import cut

GAMMA = 1.02
SPREAD = 4.0
#: Documents that a group's parent counts for.
PRIOR_DOCS = 50
#: Ratios, the side on which they can be bad, and the least distance of a limit from the median.
RATIOS = {"symbols_per_word": ("high", 0.2), "repeat_share": ("high", 0.2), "echo_share": ("high", 0.1), "dup_line_share": ("high", 0.34), "upper_share": ("high", 0.15), "mean_word": ("both", 3.0)}
#: Groups of language and source up to which the limits are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 20_000

_SPACES = " \t\n\x0b\f\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bind(value: Column, body) -> Column:
    """body(x) with x evaluated once a row, though body may use it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words of an array that lie in a window of `width` words occurring twice or more in it."""

    def covered(hashes: Column) -> Column:
        def spans(found: Column) -> Column:
            def total(at: Column) -> Column:
                gaps = F.transform(at, lambda x, j: F.when(j == 0, width).otherwise(F.least(F.lit(width), x - at[j - 1])))
                return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

            same = F.filter(found, lambda x, j: ((j > 0) & (F.get(found, j - 1)["h"] == x["h"])) | F.coalesce(F.get(found, j + 1)["h"] == x["h"], F.lit(False)))
            return bind(F.array_sort(F.transform(same, lambda x: x["i"])), total)

        return bind(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), spans)

    hashes = F.when(F.size(words) < width, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width)))))
    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts (long), upper-case letters, lines with a word, and words equal to the one before them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(_SPACES))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACES)) != "")

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), repeated_words(words).alias("r"), F.size(F.filter(words, lambda x, i: (i > 0) & (F.get(words, i - 1) == x))).alias("e"))

    empty = trimmed == ""
    words = bind(F.split(trimmed, "[ \\t-\\r]+", -1), counts)
    line = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    docs = docs.drop(*BASE, "n_upper", "n_lines", "n_echoes", "__w", "__l").withColumn("__w", F.when(~empty, words)).withColumn("__l", line)
    return docs.withColumns(
        {
            "n_words": F.coalesce(F.col("__w.n"), F.lit(0)).cast("long"),
            "n_repeat_words": F.coalesce(F.col("__w.r"), F.lit(0)).cast("long"),
            "n_echoes": F.coalesce(F.col("__w.e"), F.lit(0)).cast("long"),
            "n_lines": F.col("__l.n").cast("long"),
            "n_dup_lines": F.col("__l.d").cast("long"),
            "word_chars": F.length(F.regexp_replace(whole, "[ \\t-\\r]+", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]+", ""))).cast("long"),
            "n_upper": (F.length(whole) - F.length(F.regexp_replace(whole, "\\p{Lu}+", ""))).cast("long"),
        }
    ).drop("__w", "__l")


def with_ratios(features: DataFrame) -> DataFrame:
    """features with base_failed and the ratios; they are null for texts without words."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return features.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbols_per_word": F.col("n_symbols") / words,
            "repeat_share": F.col("n_repeat_words") / words,
            "echo_share": F.col("n_echoes") / words,
            "dup_line_share": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")),
            "upper_share": F.col("n_upper") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
            "mean_word": F.col("word_chars") / words,
        }
    )


def sketches(ratios: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, ratio, bucket, n): one sketch for each group and ratio. Sums over groups are sketches again."""
    log = math.log(GAMMA)
    bucket = {r: F.when(F.col(r) > 0, F.ceil(F.log(F.col(r)) / log).cast("int")).otherwise(F.lit(-(1 << 30))) for r in RATIOS}
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), b.alias("bucket")) for r, b in bucket.items())))
    used = ratios.where(F.col("n_words") > 0).select(F.col(lang).alias("lang"), F.col(source).alias("source"), rows.alias("x"))
    return used.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ratio, n_docs and the quartiles q25, q50, q75 of each sketch, from its buckets in one array."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    one = merged.withColumn("n", F.col("n").cast("double")).groupBy(*keys, "ratio").agg(F.sum("n").alias("n_docs"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))

    def at(q: float) -> Column:
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("at"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= (q - 1e-9) * F.col("n_docs"), x["bucket"])).alias("at"))
        found = F.aggregate("b", start, step)["at"]
        return F.when(found == -(1 << 30), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), found) / (GAMMA + 1))

    return one.select(*keys, "ratio", "n_docs", *(at(q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)))


def merged_sketches(groups: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): each group's sketch with its language's and the corpus', n being shares."""
    parent = None
    for keys in ([], ["lang"], ["lang", "source"]):
        own = groups.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        sizes = own.groupBy(*keys, "ratio").agg(F.sum("n").alias("size"))
        prior = PRIOR_DOCS if keys else 0
        named = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("ratio").alias("__ratio"), "size")
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("ratio") == F.col("__ratio"))
        shares = own.join(named, same).select(*keys, "ratio", "bucket", (F.col("n") / (F.col("size") + prior)).alias("n"))
        if keys:
            above = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys[:-1]), F.col("ratio") == F.col("__ratio"))
            lent = named.join(parent, above).select(*(F.col(f"__{k}").alias(k) for k in keys), "ratio", "bucket", (prior * F.col("n") / (F.col("size") + prior)).alias("n"))
            shares = shares.unionByName(lent).groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        parent = shares
    return parent


def limits(ratios: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, low_*, high_*) for every group."""
    groups = cut(sketches(ratios, lang, source))
    picked = quantiles(merged_sketches(groups), ["lang", "source"])
    out = []
    for ratio, (side, slack) in RATIOS.items():
        here = F.col("ratio") == ratio
        high = F.col("q50") + F.greatest(SPREAD * (F.col("q75") - F.col("q50")), F.lit(slack))
        low = F.col("q50") - F.greatest(SPREAD * (F.col("q50") - F.col("q25")), F.lit(slack))
        out.append(F.max(F.when(here, high)).alias(f"high_{ratio}"))
        if side == "both":
            out.append(F.max(F.when(here, low)).alias(f"low_{ratio}"))
    return cut(picked.groupBy("lang", "source").agg(*out))


def judge(ratios: DataFrame, bounds: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """ratios with kept: the base rules hold and every ratio lies within its group's limits."""
    names = [c for c in bounds.columns if c not in ("lang", "source")]
    side = bounds.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *names)
    if len(bounds.select("lang").take(BROADCAST_GROUPS + 1)) <= BROADCAST_GROUPS:
        side = F.broadcast(side)
    joined = ratios.join(side, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    inside = [F.col(r) <= F.col(f"high_{r}") for r in RATIOS] + [F.col(r) >= F.col(f"low_{r}") for r, (side_, _) in RATIOS.items() if side_ == "both"]
    kept = ~F.col("base_failed") & reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(True)) for x in inside))
    return joined.withColumn("kept", kept).drop("__lang", "__source", *names)


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, base counts, base_failed, kept) for every row; the features are computed once and kept without the texts."""
    features = with_features(docs.select(F.col(id_column), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")))
    features = with_ratios(cut(features.drop("text")))
    return judge(features, limits(features)).select(id_column, *BASE, "base_failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept. The features are computed once, beside the rows, and read again with the limits; texts are never shuffled."""
    columns = docs.columns
    named = docs.select(*(F.col(c).alias(f"c_{c}") for c in columns))
    ratios = with_ratios(cut(with_features(named, f"c_{text}")))
    kept = judge(ratios, limits(ratios, f"c_{lang}", f"c_{source}"), f"c_{lang}", f"c_{source}").where("kept")
    return kept.select(*(F.col(f"c_{c}").alias(c) for c in columns))
