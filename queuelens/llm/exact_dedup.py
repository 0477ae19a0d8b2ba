"""Exact deduplication by skew-safe combining.

Equal texts meet in three stages: in each map task (partial aggregation), among rows of one salt,
and among the winners of all salts. At each stage the grouping key is the digest together with the
whole text, so rows only merge when their content is the same; a stage receives at most one
row for each text from each task of the stage before, however many copies there are.

The group of a row is then looked up by digest alone, unless two texts share a digest; those
digests' rows are looked up by text as well.

Edge cases: NULL text counts as empty; a NULL doc_id is smaller than any other; of rows equal in
doc_id and text one is kept; texts of any length are compared whole; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from queuelens.llm.common import keep_matching
from queuelens.session import materialize

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_groups(docs: DataFrame, normal: Callable[[Column], Column] | None = None, digest=sha256, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, group_size), one row for each distinct text."""
    text = F.coalesce("text", F.lit(""))
    text = normal(text) if normal else text
    rows = docs.select(
        "doc_id", text.alias("text"), digest(text).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    salted = rows.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def dedup_exact(docs: DataFrame, normal: Callable[[Column], Column] | None = None, digest=sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each row of `docs`."""
    text = F.coalesce("text", F.lit(""))
    text = normal(text) if normal else text
    groups = text_groups(docs, normal, digest, salts)
    # A second text of the same digest is told by its own hash; only such digests keep more than one row.
    groups = materialize(groups.select("digest", F.xxhash64("text").alias("hash"), "keep_id", "group_size"), "exact-groups")
    shared = groups.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("digest")
    # Rows equal in id and text differ in nothing that the group is about; the first one can be kept.
    place = F.row_number().over(Window.partitionBy("digest", "doc_id", "hash").orderBy("hash")).alias("place")
    rows = docs.select("doc_id", digest(text).alias("digest"), F.xxhash64(text).alias("hash")).select("*", place)
    if shared.isEmpty():
        found = rows.join(groups.select("digest", "keep_id", "group_size"), "digest")
    else:
        shared = materialize(shared, "exact-shared")
        by_text = text_groups(docs, normal, digest, salts).join(shared, "digest", "left_semi")
        alone = rows.join(groups.join(shared, "digest", "left_anti").select("digest", "keep_id", "group_size"), "digest")
        again = docs.select("doc_id", digest(text).alias("digest"), text.alias("text")).join(shared, "digest", "left_semi")
        again = again.select("*", F.row_number().over(Window.partitionBy("digest", "doc_id", "text").orderBy("text")).alias("place"))
        names = ["doc_id", "digest", "place", "keep_id", "group_size"]
        found = alone.select(*names).union(again.join(by_text, ["digest", "text"]).select(*names))
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", (own & (F.col("place") == 1)).alias("kept"), "digest")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    kept = dedup_exact(docs, **options).where("kept").select("doc_id", "digest")
    text = F.coalesce("text", F.lit(""))
    normal, digest = options.get("normal"), options.get("digest", sha256)
    return keep_matching(docs, kept, {"doc_id": F.col("doc_id"), "digest": digest(normal(text) if normal else text)}, once=True)
