"""Mixing sources to target weights by weighted fair queueing.

Every document of a shuffled source, and once more when the source is repeated, gets a virtual
finish time: its source's words up to and including it, divided by the source's target. Sorting
all documents by that time interleaves the sources in proportion to their targets; the mix is the
head of that order up to the total budget.

Running sums are never one task's work: a source's shuffled order is cut into buckets by the
leading digits of the shuffle key, bucket totals are summed, and only rows of one bucket meet. The
global order is cut the same way by ranges of the finish time. Buckets grow in number and in rows, each
with the root of the row count, so that neither the sums nor a bucket is a large task.

Edge cases: NULL and empty texts have size 0 and are taken 0 words; a NULL source is a source of
its own, last; a NULL doc_id is shuffled by its text; repeated rows count as often as they occur;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from queuelens.llm.common import WORD, bucket_count, unused
from queuelens.session import materialize

#: The weights of sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix holds this share of all words, and no document more often than MAX_EPOCHS times.
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
BUCKET_ROWS = 2000
SEED = 7


def targets(sources: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds each source's `target` to (source, source_size).

    With `level` the words for each unit of weight, a target is min(epochs * size, level * weight). Sources
    reach their cap in the order of cap / weight, so the level follows from running sums in that
    order. One row for each source, so the windows here are small.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * epochs).cast("double")
    order = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("rest") / F.col("open") <= F.col("ratio"), F.col("rest") / F.col("open")))
    )
    # Rows after the first open one assume too much taken away, so their level is lower.
    level = F.max("level").over(whole)
    return ranked.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), "cap"))).select(
        "source", "source_size", "weight", "target"
    )


def shuffle_key(seed: int) -> Column:
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.md5(F.concat_ws(":", F.lit(seed), own))


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def bucket_of(key: Column, buckets: Column) -> Column:
    """The range of a hexadecimal key, by its leading digits."""
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.floor(lead * buckets / 4294967296).cast("bigint")


def running(df: DataFrame, value: str, to: str, order: list, within: tuple[str, ...], bucket: str) -> DataFrame:
    """Adds the running sum of `value` in the given order, which sorts by `bucket` first."""
    earlier = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*within, bucket).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in (*within, bucket)], before.alias("_before"))
    inner = Window.partitionBy(*within, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_inner", F.sum(value).over(inner))
    same = [summed[c].eqNullSafe(totals[f"_{c}"]) for c in (*within, bucket)]
    return summed.join(totals, same).select(*df.columns, (F.col("_before") + F.col("_inner")).alias(to))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED,
        bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents, mixture): every document with its source's figures, and the taken copies in their order.

    documents: doc_id, source, size, key, finish; source_size, target.
    mixture: doc_id, source, size, key, copy, finish, position; the words before it are position - size.
    """
    sized = materialize(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), shuffle_key(seed).alias("key")),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(targets(sources, weights, share, epochs).join(
        sources.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-sources")
    # Few rows: one for each source.
    buckets = bucket_count(F.col("n"), bucket_rows).alias("buckets")
    figures = sources.select(F.col("source").alias("_s"), "source_size", "target", buckets)
    known = sized.join(figures, sized["source"].eqNullSafe(figures["_s"])).drop("_s")
    known = known.withColumn("bucket", bucket_of(F.col("key"), F.col("buckets"))).drop("buckets")
    summed = running(known, "size", "sum", ["key", "size"], ("source",), "bucket").drop("bucket")
    finish = lambda copy: (F.col("sum") + F.col("source_size") * copy) / F.col("target")
    stored = materialize(summed.where(F.col("size") > 0).withColumn("finish", finish(0)), "mix-order")
    copies = stored.select(
        "doc_id", "source", "size", "key", F.posexplode(F.array(*[finish(i) for i in range(epochs)])).alias("copy", "finish")
    )
    whole = sources.agg((F.sum("source_size") * share).alias("budget"), bucket_count(F.sum("n"), bucket_rows).alias("ranges")).first()
    budget, ranges = whole.budget or 0, whole.ranges or 1
    # Up to time 1 each source gives its target; ranges beyond 2 widen, as a long tail lies there.
    late = F.lit(2 * ranges) + F.floor(F.log2(F.col("finish") / 2) * ranges)
    copies = copies.withColumn("range", F.when(F.col("finish") <= 2, F.floor(F.col("finish") * ranges)).otherwise(late).cast("bigint"))
    placed = running(copies, "size", "position", ["finish", "source", "key", "size", "copy"], (), "range")
    return known, placed.where(F.col("position") <= budget)


def own_copies(rows: DataFrame, mixture: DataFrame, on: dict[str, Column]) -> tuple[DataFrame, str]:
    """Adds how often the mixture takes each row, in a new column that is named.

    Rows that agree in all of `on` share what the mixture took of them; counting them uses the join's
    partitioning and order.
    """
    names = {k: unused(rows.columns, f"_{k}") for k in on}
    got = mixture.groupBy(*on).agg(F.count("*").alias("_copies"))
    got = got.select(*[F.col(k).alias(names[k] + "_r") for k in on], F.col("_copies").alias(copies := unused(rows.columns, "_copies")))
    left = rows.withColumns({names[k]: v for k, v in on.items()})
    joined = left.join(got, [left[n].eqNullSafe(got[n + "_r"]) for n in names.values()], "left")
    same = Window.partitionBy(*names.values()).orderBy(*names.values())
    n = F.count("*").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    whole, i = F.coalesce(copies, F.lit(0)), F.row_number().over(same)
    own = F.floor(whole / n) + (i <= whole % n).cast("bigint")
    return joined.select(*[left[c] for c in rows.columns], own.alias(copies)), copies


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every document."""
    known, mixture = mix(docs, **options)
    rows, copies = own_copies(known, mixture, {c: F.col(c) for c in ("key", "source", "size", "doc_id")})
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col(copies)).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mixture takes them."""
    _, mixture = mix(docs, seed=seed, **options)
    on = {"key": shuffle_key(seed), "source": F.col("source").cast("string"), "size": word_count(), "doc_id": F.col("doc_id")}
    rows, copies = own_copies(docs, mixture, on)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))
    return rows.where(F.col(copies) > 0).select(*[f"`{c}`" for c in docs.columns], again.alias(unused(docs.columns, "_again"))).select(
        *[f"`{c}`" for c in docs.columns]
    )
