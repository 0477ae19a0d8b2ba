"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints collapse first. Distinct ones are packed into tiles of one population count
each (popular counts take several tiles), a tile being one row with an array. Two fingerprints that
differ in at most `radius` bits have population counts at most `radius` apart, so only such tile
pairs are formed; each is compared whole by exclusive-or and bit counts in one task. A pair of tiles
returns no more than one link for each fingerprint, to the smallest of its component there, which
loses no connection.

Work grows with the square of the distinct fingerprints, cut by the population counts; a task's
memory and its output are bounded by the tile.

Edge cases: NULL and empty texts have fingerprint zero and link like any other; texts shorter than a
shingle are one shingle; long texts are hashed in blocks, whole; a NULL doc_id is never a
component's smallest unless all are NULL; repeated rows get equal rows; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from queuelens.llm.common import components, keep_matching, local_roots
from queuelens.session import materialize

TILE = 8192
BLOCK = 1 << 16
STRIPE = 128


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint over word shingles; bits set in more than half of the hashes."""
    import numpy as np
    import xxhash

    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = (text or "").encode().translate(lower).split()  # splits at the six ASCII white-space bytes
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if c else "0" for c in counts * 2 > n), 2)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of every row; the fingerprint as a signed bigint."""

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            prints = [fingerprint(t, words, seed) for t in batch.column("text").to_pylist()]
            signed = pa.array([p - (1 << 64) if p >> 63 else p for p in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), signed], ["doc_id", "text_hash", "fingerprint"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"doc_id {kind}, text_hash bigint, fingerprint bigint")


def close_pairs(left, right, radius: int, same: bool):
    """Index pairs of two uint64 arrays that differ in at most `radius` bits, stripe by stripe."""
    import numpy as np

    for at in range(0, len(left), STRIPE):
        near = np.bitwise_count(left[at : at + STRIPE, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def tile_links(radius: int):
    def linked(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for a, b, same in zip(batch.column("left"), batch.column("right"), batch.column("same").to_pylist()):
                left = a.values.to_numpy().view(np.uint64)
                right = left if same else b.values.to_numpy().view(np.uint64)
                both = left if same else np.concatenate([left, right])
                ordered = np.argsort(both.view(np.int64), kind="stable")  # so that the smallest index is the smallest print
                rank = np.empty(len(both), np.int64)
                rank[ordered] = np.arange(len(both))
                shift, root = 0 if same else len(left), np.arange(len(both))
                for i, j in close_pairs(left, right, radius, same):
                    root = local_roots(len(both), np.concatenate([np.arange(len(both)), rank[i]]), np.concatenate([root, rank[j + shift]]))
                values = both.view(np.int64)[ordered]
                moved = root != np.arange(len(both))
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[root[moved]])], ["a", "b"])

    return linked


def links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within `radius` bits."""
    weight = F.bit_count("fingerprint").cast("int")
    sizes = prints.groupBy(weight.alias("weight")).agg(F.count("*").alias("n"))
    # At most 65 rows: how many tiles each population count takes.
    tiles = {r.weight: -(-r.n // tile) for r in sizes.collect()}
    if not tiles:
        return prints.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"))
    spread = F.element_at(F.array(*[F.lit(tiles.get(w, 1)) for w in range(65)]), weight + 1)
    rows = prints.select("fingerprint", weight.alias("weight"), F.pmod(F.xxhash64(F.lit("tile"), "fingerprint"), spread).alias("part"))
    packed = materialize(rows.groupBy("weight", "part").agg(F.collect_list("fingerprint").alias("prints")), "simhash-tiles")
    names = packed.select("weight", "part")
    # Tile pairs: those of one count, each with itself and the later ones, and those of the next `radius` counts.
    up = names.select(
        F.col("weight").alias("lw"), F.col("part").alias("lp"), F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("step")
    ).withColumn("weight", F.col("lw") + F.col("step"))
    pairs = up.join(names, "weight").where((F.col("step") > 0) | (F.col("lp") <= F.col("part")))
    pairs = materialize(pairs.select("lw", "lp", F.col("weight").alias("rw"), F.col("part").alias("rp")), "simhash-pairs")
    lefts = packed.select(F.col("weight").alias("lw"), F.col("part").alias("lp"), F.col("prints").alias("left"))
    rights = packed.select(F.col("weight").alias("rw"), F.col("part").alias("rp"), F.col("prints").alias("right"))
    same = (F.col("lw") == F.col("rw")) & (F.col("lp") == F.col("rp"))
    work = pairs.join(lefts, ["lw", "lp"]).join(rights, ["rw", "rp"])
    work = work.select("left", "right", same.alias("same"), "lw", "lp", "rw", "rp")
    parallel = prints.sparkSession.sparkContext.defaultParallelism
    work = work.repartition(max(2 * parallel, pairs.count() // 8), "lw", "lp", "rw", "rp").select("left", "right", "same")
    return work.mapInArrow(tile_links(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component, component_id) of every row.

    `component` is the smallest fingerprint, which no two components share; their smallest doc_id may be the same.
    """
    rows = materialize(fingerprints(docs, words, seed), "simhash-prints")
    prints = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    # Only fingerprints with links take part; what links nothing is its own component.
    parts = components(links(prints.select("fingerprint"), radius, tile), "simhash")
    named = prints.join(parts, prints["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
    )
    named = materialize(named, "simhash-named")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    smallest = materialize(smallest, "simhash-smallest")  # on its own, so that AQE can split a hot component
    classes = named.join(smallest, "component").select("fingerprint", "component", "component_id")
    return rows.join(classes, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component", "component_id")


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """One row of `docs`, with all its columns, for each component: that with the smallest doc_id."""
    found = near_duplicates(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # An id may repeat with other texts of its component; one of them stays. Components of one smallest id stay apart.
    found = found.groupBy("component", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    return keep_matching(docs, found, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text")}, once=True)
