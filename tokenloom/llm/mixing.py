"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the mixture over its share of the corpus, times the
number of epochs. A document's count is the inverse of the Poisson distribution with that mean at a uniform number
hashed from seed and id, so that it depends on nothing else; the document is repeated by its count, and the copies
are dealt and sorted by a second hash.

Defined cases: a null source is a source of its own; sources missing from the weights get weight 0; null and empty
texts count as size 0 but are repeated like others; rows with the same id get the same count; a source whose size is
0 has rate 0; an empty table gives an empty mixture. All columns are kept; the added ones (copy_no, shuffle_key)
replace input columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import cut

#: Sources, and values of their distribution functions, up to which the table of rates is broadcast; beyond them the join shuffles.
BROADCAST_SOURCES, BROADCAST_VALUES = 2000, 1_000_000
#: Counts from which on the series for the logarithm of a factorial is used.
SERIES = 64


def uniform(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(c.cast("string") for c in columns)).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | float = 0.5, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): how often a document of the source should occur on average.

    weights: the share that each source should have of the mixture's characters, or a power: each source's share is
    then its size to that power.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("size"))
    if isinstance(weights, dict):
        pairs = [(k, float(v)) for k, v in weights.items()]
        table = docs.sparkSession.createDataFrame(pairs, "source string, weight double")
        sizes = sizes.alias("a").join(table.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(float(weights)))).otherwise(0.0))
    total = sizes.agg(F.sum("size").alias("sizes"), F.sum("weight").alias("weights"))
    rate = F.lit(float(epochs)) * (F.col("weight") / F.col("weights")) * (F.col("sizes") / F.col("size"))
    return sizes.crossJoin(F.broadcast(total)).select("source", F.when((F.col("size") > 0) & (F.col("weights") > 0), rate).otherwise(0.0).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, first, steps) for rates(source, rate): the distribution function of a Poisson variable at first, first + 1, ...

    The values run from 12 standard deviations below the mean to 12 above it, as far as doubles tell them from 0 and 1:
    about 24 times the root of the rate. They are running sums of the probabilities, each from its own logarithm.
    """
    wide = F.ceil(12 * F.sqrt("rate") + 30)
    first = F.greatest(F.lit(0).cast("long"), F.floor("rate") - wide)
    k, rate = F.col("k").cast("double"), F.col("rate")
    factorials = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(SERIES)))
    x = (rate - k) / k
    near = k * (F.log1p(x) - x) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k**3) - 1 / (1260 * k**5)
    log = F.when(F.col("k") < SERIES, k * F.log(rate) - rate - F.get(factorials, F.col("k").cast("int"))).otherwise(near)
    term = F.when(rate > 0, F.exp(log)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    values = rates.select("source", "rate", first.alias("first"), F.explode(F.sequence(first, F.when(rate > 0, F.floor("rate") + wide).otherwise(F.lit(0).cast("long")))).alias("k"))
    summed = values.withColumn("c", F.sum(term).over(Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return summed.groupBy("source", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda v: v["c"]).alias("steps"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | float = 0.5, epochs: float = 1.0, seed: str = "mix", id_column: str = "doc_id", source: str = "source", text: str = "text", partitions: int | None = None) -> DataFrame:
    """docs, each row repeated by its Poisson count, with copy_no (from 1) and shuffle_key, in the order of shuffle_key in each partition."""
    docs = docs.drop("copy_no", "shuffle_key")
    steps = cut(poisson_steps(source_rates(docs, weights, epochs, source, text)))
    size = steps.agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.size("steps")), F.lit(0)).alias("values")).first()
    rates = steps.select(F.col("source").alias("__source"), F.col("first").alias("__first"), F.col("steps").alias("__steps"))
    if size.sources <= BROADCAST_SOURCES and size["values"] <= BROADCAST_VALUES:
        rates = F.broadcast(rates)
    drawn = docs.join(rates, F.col(source).eqNullSafe(F.col("__source")))
    # the number is an array's only element, so that it is worked out once a document and not at each step
    steps_below = F.transform(F.array(uniform(f"{seed}:count", F.col(id_column))), lambda u: F.size(F.filter("__steps", lambda c: c <= u)))[0]
    drawn = drawn.withColumn("__count", F.col("__first") + steps_below)
    copies = drawn.where("__count > 0").drop("__source", "__first", "__steps").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__count").cast("int")))).drop("__count")
    copies = copies.withColumn("shuffle_key", uniform(f"{seed}:order", F.col(id_column), F.col("copy_no")))
    dealt = copies.repartition(partitions, "shuffle_key") if partitions else copies.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key", id_column, "copy_no")


#: mix_sources() on documents with its defaults, as DuckDB SQL; {columns} are the columns to return.
ORACLE = """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM {documents} GROUP BY source),
weighted AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END AS weight FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 AND (SELECT sum(weight) FROM weighted) > 0 THEN weight / (SELECT sum(weight) FROM weighted) * ((SELECT sum(size) FROM sizes) / size) ELSE 0 END AS rate FROM weighted),
terms AS (SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS term FROM rates, range(0, 400) AS r(k)),
steps AS (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT *, ('0x' || substr(md5('mix:count:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM {documents}),
counted AS (SELECT *, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM drawn.source AND s.c <= drawn.u) AS n FROM drawn),
copies AS (SELECT * EXCLUDE (u, n), unnest(range(1, n + 1))::INT AS copy_no FROM counted WHERE n > 0)
SELECT {columns} FROM copies
"""
