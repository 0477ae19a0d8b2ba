"""Line deduplication by a deletion-neighbourhood join.

Two lines are alike if they are equal, or both have at least `min_near` characters and one insertion,
deletion or replacement turns the one into the other. A line is dropped if an earlier one (by doc_id,
then its place in the document) is alike, whether that one is dropped itself or not; so the result
depends on no order of work.

Equal lines collapse by a 128-bit hash. Of the distinct lines only those are looked at further that
agree with another one in a half, and of these those that agree in all but an eighth: a single edit
leaves what stands before its part and behind it unchanged, so nothing is lost. They emit all their deletion variants as hashed keys with the place
of the deletion. Lines with the same variant and place differ in one replacement; a line equal to
another one's variant differs in one insertion. The earliest line of each key is an aggregate, so
a key shared by many lines makes no pairs. Each line's earliest partner is verified by edit
distance on the texts.

Edge cases: NULL text has no lines and stays NULL; empty and blank lines are never dropped; lines are
compared without white space at their ends; a line of any length is hashed in blocks; other columns are
not read and not returned, whatever their names; rows with a NULL id come last; rows equal in id and text
are one document and get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from queuelens.session import materialize

MIN_NEAR = 20
#: Keys of two bigints that a broadcast may hold: about 50 MB.
BROADCAST_ROWS = 1_000_000
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASE = 1_000_003
#: Characters of a line that are hashed at once.
BLOCK = 32_768


def line_rows(docs: DataFrame) -> DataFrame:
    """(place, line, k1, k2): every line that isn't blank, trimmed; `place` orders lines."""
    row = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("number", "line"))
    row = row.withColumn("line", F.trim("line", F.lit(" \t\r\x0b\f"))).where(F.length("line") > 0)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "number")
    return row.select(place.alias("place"), "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("line"), "line").alias("k2"))


def part_keys(line, parts: int):
    """Keys of which two lines within one edit share at least one: all of a line but one of its parts.

    In the places of the shorter line the edit lies in one part; what stands before that part and what
    stands behind it is the same in both lines.
    """
    keys = []
    for shorter in (0, 1):  # the line as the shorter of a pair, or of the same length; as the longer one
        size = F.length(line) - shorter
        edge = lambda q: F.floor(size * q / parts).cast("int")
        for q in range(parts):
            behind = size - edge(q + 1)
            ends = [F.substr(line, F.lit(1), edge(q))] * (q > 0) + [F.substr(line, F.length(line) - behind + 1, behind)] * (q < parts - 1)
            keys.append(F.xxhash64(F.lit(q), size, *ends))
    return F.array(*keys)


def sharing_a_key(lines: DataFrame, label: str) -> DataFrame:
    """(k1, k2) of the distinct `lines` (k1, k2, keys) that share one of `keys` with another one."""
    exploded = lines.select("k1", "k2", F.explode("keys").alias("key"))
    shared = materialize(exploded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key"), f"{label}-keys")
    return materialize(exploded.join(shared, "key", "left_semi").select("k1", "k2").distinct(), label)


def few(rows: DataFrame) -> DataFrame:
    """Marks a stored table for broadcasting while it has at most BROADCAST_ROWS rows; a larger one is shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


@functools.cache
def powers():
    """Powers of the base up to a block's length, a row for each prime; built once a process."""
    import numpy as np

    row, primes = np.ones((len(PRIMES), 1), np.uint64), np.array(PRIMES, np.uint64)[:, None]
    while row.shape[1] < BLOCK:
        step = np.array([[pow(BASE, row.shape[1], p)] for p in PRIMES], np.uint64)
        row = np.concatenate((row, row * step % primes), axis=1)
    return row, primes


def variant_blocks(line: str):
    """(v1, v2, first spot) for blocks of a line's deletions in order, then for the line itself with spot -1.

    A variant is hashed to two 62-bit numbers. With w(j) the weighted character j and s(i) the sum of those before i,
    what is left without i is s(i) shifted by one place and whole - s(i + 1). Memory is the line's and one block's.
    """
    import numpy as np

    table, primes = powers()
    code = np.frombuffer(line.encode("utf-32-le"), "<u4")
    n = len(code)

    def weighted(at: int):
        part = code[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
        found = part * table[:, len(part) - 1 :: -1][:, : len(part)] % primes
        behind = n - at - len(part)
        return found * np.array([[pow(BASE, behind, p)] for p in PRIMES], np.uint64) % primes if behind else found

    def packed(v):
        return tuple((v[i] << np.uint64(31) | v[i + 1]).astype(np.int64) for i in (0, 2))

    whole = np.zeros((len(PRIMES), 1), np.uint64)
    for at in range(0, n, BLOCK):
        first = weighted(at)
        whole = (whole + first.sum(axis=1, keepdims=True)) % primes
    unshift = np.array([[pow(BASE, -1, p)] for p in PRIMES], np.uint64)
    before = np.zeros_like(whole)
    for at in range(0, n, BLOCK):
        own = first if n <= BLOCK else weighted(at)
        upto = (before + np.cumsum(own, axis=1)) % primes
        sums = np.concatenate((before, upto[:, :-1]), axis=1)
        yield *packed((sums * unshift + whole + primes - upto) % primes), at
        before = upto[:, -1:]
    yield *packed(whole), -1


def with_variants(batches):
    """(id, v1, v2, spot): a row for each deletion of a line, and one with spot -1 for the line itself.

    Rows leave in batches of about a block, so a line of any length takes no more than its own characters.
    """
    import numpy as np
    import pyarrow as pa

    names = ["id", "v1", "v2", "spot"]
    ready, n = [], 0
    for batch in batches:
        for number, line in zip(batch.column("id").to_pylist(), batch.column("line")):
            for v1, v2, at in variant_blocks(line.as_py()):
                spot = np.arange(at, at + len(v1), dtype=np.int32)
                ready.append((np.full(len(v1), number, np.int64), v1, v2, spot))
                n += len(v1)
                if n >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready)], names)
                    ready, n = [], 0
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready)], names)


def near_lines(docs: DataFrame, distinct: DataFrame, min_near: int) -> DataFrame:
    """(k1, k2): the distinct lines that have an earlier one within one edit."""
    long = distinct.where(F.col("size") >= min_near)
    chosen = sharing_a_key(long.select("k1", "k2", F.col("halves").alias("keys")), "line-halves")
    texts = line_rows(docs).join(few(chosen), ["k1", "k2"], "left_semi").select("k1", "k2", "line").distinct()
    texts = materialize(texts, "line-texts")
    # The few texts left allow for finer keys, which leave little but lines within one edit.
    chosen = sharing_a_key(texts.select("k1", "k2", part_keys(F.col("line"), 8).alias("keys")), "line-eighths")
    texts = texts.join(chosen, ["k1", "k2"], "left_semi").join(distinct.select("k1", "k2", "first"), ["k1", "k2"])
    # Numbers in the order of the lines, without gathering them.
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    ordered = texts.repartitionByRange(parallel, "first").sortWithinPartitions("first")
    texts = materialize(ordered.select("k1", "k2", "line", F.monotonically_increasing_id().alias("id")), "line-numbers")
    parts = texts.select("id", "line").repartition("id").mapInArrow(with_variants, "id bigint, v1 bigint, v2 bigint, spot int")
    own = F.col("spot") < 0
    by_key = parts.groupBy("v1", "v2").agg(
        F.min("id").alias("low"), F.max("id").alias("high"),
        F.min(F.when(own, F.col("id"))).alias("whole"), F.min(F.when(~own, F.col("id"))).alias("cut"),
    )
    by_key = materialize(by_key.where(F.col("low") != F.col("high")).select("v1", "v2", "whole", "cut"), "line-keys")
    met = materialize(parts.join(by_key, ["v1", "v2"]), "line-met")
    by_spot = met.where(~own).groupBy("v1", "v2", "spot").agg(F.min("id").alias("swap"))
    by_spot = materialize(by_spot, "line-spots").withColumnsRenamed({"v1": "w1", "v2": "w2", "spot": "at"})
    same = [met["v1"] == by_spot["w1"], met["v2"] == by_spot["w2"], met["spot"] == by_spot["at"]]
    partner = F.when(own, F.col("cut")).otherwise(F.least("whole", "swap"))
    found = met.join(by_spot, same, "left").select("id", partner.alias("partner")).where(F.col("partner") < F.col("id"))
    found = found.groupBy("id").agg(F.min("partner").alias("partner"))
    right = texts.select(F.col("id").alias("partner"), F.col("line").alias("other"))
    pairs = found.join(texts, "id").join(right, "partner")
    return pairs.where(F.levenshtein("line", "other", 1).between(0, 1)).select("k1", "k2")


def dedup_lines(docs: DataFrame, bound: int = 1, min_near: int = MIN_NEAR) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every document with its remaining lines."""
    if bound not in (0, 1):
        raise ValueError("variants are emitted for at most one edit")
    lines = line_rows(docs)
    # Everything but the line itself is fixed-size, so no text is shuffled here.
    sized = lines.select("place", "k1", "k2", F.length("line").alias("size"), part_keys(F.col("line"), 2).alias("halves"))
    sized = materialize(sized, "line-rows")
    distinct = sized.groupBy("k1", "k2", "size", "halves").agg(F.min("place").alias("first"))
    distinct = materialize(distinct, "line-distinct")
    known = distinct.select("k1", "k2", "first").withColumn("near", F.lit(False))
    if bound:
        near = near_lines(docs, distinct, min_near).select("k1", "k2", F.lit(True).alias("near"))
        known = distinct.select("k1", "k2", "first").join(near, ["k1", "k2"], "left")
    known = materialize(known, "line-known")
    dropped = sized.select("place", "k1", "k2").join(known, ["k1", "k2"]).where(F.coalesce("near", F.lit(False)) | (F.col("place") != F.col("first")))
    dropped = dropped.select("place.doc_id", "place.text_hash", "place.number").distinct()
    dropped = materialize(
        dropped.groupBy("doc_id", "text_hash").agg(F.collect_list("number").alias("numbers"))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "numbers"), "line-dropped",
    )
    rows = docs.select("doc_id", "text").withColumn("_own", F.xxhash64("text"))
    rows = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left").select("doc_id", "text", "numbers")

    def rebuilt(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts, gone = [], [], []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column("numbers").to_pylist()):
                own, drop = [] if text is None else text.split("\n"), set(numbers or ())
                counts.append(len(own))
                gone.append(len(drop))
                texts.append(text if not drop else "\n".join(x for i, x in enumerate(own) if i not in drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(rebuilt, f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint")
