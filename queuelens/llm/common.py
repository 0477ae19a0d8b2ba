"""Column helpers and connected components, shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from queuelens.session import materialize

#: Runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def bucket_count(n: Column, rows: int) -> Column:
    """How many buckets n rows are cut into: of `rows` rows each, and of more once sqrt(n) is more.

    One window adds the buckets' sums up, others the rows of a bucket: neither has more than sqrt(n) rows.
    """
    return F.greatest(F.lit(1), F.ceil(n / F.greatest(F.lit(rows), F.ceil(F.sqrt(n))))).cast("bigint")


def unused(columns: Iterable[str], base: str) -> str:
    """`base`, lengthened until it clashes with none of `columns` in any letter case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def keep_matching(docs: DataFrame, keys: DataFrame, on: dict[str, Column], once: bool = False) -> DataFrame:
    """Rows of `docs`, with its columns alone, whose values `on` occur in the like-named columns of `keys`.

    NULL matches NULL. With `once`, one row stays of those that agree in all of `on`; the window
    reuses the join's partitioning and order.
    """
    names = {k: unused([*docs.columns, *keys.columns], f"_{k}") for k in on}
    left = docs.withColumns({names[k]: v for k, v in on.items()})
    right = keys.select(*[F.col(k).alias(names[k] + "_r") for k in on])
    same = [left[n].eqNullSafe(right[n + "_r"]) for n in names.values()]
    kept = left.join(right, same, "left_semi")
    if once:
        rank = unused([*docs.columns, *names.values()], "_rank")
        by = list(names.values())
        kept = kept.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*by))).where(F.col(rank) == 1)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node that can be reached.

    Alternates large-star and small-star rounds until nothing changes, a logarithmic number in
    practice. Smallest neighbours are combined map-side; the joins are plain equi-joins, whose hot
    keys AQE splits. Each round is a stored table, so a lost executor costs one round at most.
    """
    current = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-edges",
    )
    state = None
    while True:
        both = current.union(current.select("b", "a")).toDF("u", "v")
        # Stored on its own, so that AQE can split the hot keys of the join.
        lowest = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), f"{label}-lowest")
        large = both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(lowest.select("a", F.col("low").alias("b")))
        current = materialize(small.where(F.col("a") != F.col("b")).distinct(), f"{label}-edges")
        seen = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if state == seen:
            break
        state = seen
    # Stars around the smallest node now: one row for each other node, and the centres themselves.
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def local_roots(n: int, left, right):
    """For nodes 0..n-1 of one task's links: the smallest node of each one's component (numpy arrays)."""
    import numpy as np

    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            return root


#: A run of documents whose words are numbered together: so many at most, and bytes unless one alone has more.
RUN_DOCS, RUN_BYTES = 1 << 15, 1 << 25


def runs(texts):
    """Cuts a batch's texts (an Arrow column) into runs: (first row, texts as bytes with A-Z lower-cased; none for NULL)."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = (text.as_py() or "").encode().lower()  # bytes.lower() changes A-Z alone
        if held and (len(held) == RUN_DOCS or size + len(text) > RUN_BYTES):
            yield at, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def numbered(texts: list[bytes], split: Callable[[bytes], list[bytes]]):
    """(words, the word number of each token, each text's number of tokens) of one run."""
    from collections import defaultdict

    import numpy as np

    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__  # a new word takes the next number
    codes, sizes = [], []
    for text in texts:
        tokens = split(text)
        codes.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
        sizes.append(len(tokens))
    return list(numbers), np.concatenate(codes).astype(np.int64), np.array(sizes, np.int64)
