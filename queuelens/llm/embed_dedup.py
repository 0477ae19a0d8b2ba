"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Vectors are projected on many random lines. A pair collides on a line if the one lies in the
window around the other; pairs that collide on enough lines are verified by their cosine in double
precision. Window and count are set from the similarity bound: the difference of two unit vectors
at cosine c has length sqrt(2 - 2c), so a projection differs by a normal variable of that
deviation, and the collisions of a pair at the bound are binomial.

To divide the work, the rows of one label are dealt to blocks by a few of these sorted lines, each cut
into ranges with a random start; several such tables are made, so that a pair at the bound shares a block
with the wanted probability, and the number of cuts follows the number of rows. In a block, rows are
sorted along one line, and each one's window is the span of rows it is compared with. A pair
counts in the first table where it shares a block, so that no pair counts twice. Blocks of more than
`CHUNK` rows are compared as pairs of chunks in separate tasks.

Equal vectors of one label collapse first and are counted, not paired. A distinct vector has a number of its own, stored with
it, so ids that repeat, in one label or in several, connect nothing.

Edge cases: vectors that are NULL, zero, or hold NULL or non-finite components, and those without a
label or id, link with nothing; vectors of different lengths link with nothing; repeated rows link
with each other; of vectors that share an id, each is compared as any other, and a component is named by its smallest id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from queuelens.llm.common import components, local_roots
from queuelens.session import materialize

LINES = 32
#: Half a window, in deviations of a pair at the bound: of those counted, and of the sorted line that rows are met along.
WINDOW = 2.0
SWEEP = 3.5
#: Probability that a pair at the bound passes the count, and that it shares a block.
RECALL = 0.998
#: Width of the ranges that deal out blocks, in deviations of a pair at the bound.
RANGE = 7.0
BLOCK_ROWS = 1000
CHUNK = 256


def needed_count(lines: int = LINES, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest number of collisions that a pair at the bound reaches with probability `recall`."""
    p = math.erf(window / math.sqrt(2))
    tail, n = 0.0, lines
    while n > 0:
        tail += math.comb(lines, n) * p**n * (1 - p) ** (lines - n)
        if tail >= recall:
            break
        n -= 1
    return n


def block_shape(rows: int, deviation: float, recall: float = RECALL) -> tuple[int, int]:
    """(cuts of a block key, tables) for that many rows under one label."""
    width = RANGE * deviation
    # Of a pair at the bound: both in one range of random start. Of unrelated unit vectors: likewise, deviation sqrt(2).
    together = math.erf(RANGE / math.sqrt(2)) - math.sqrt(2 / math.pi) * (1 - math.exp(-RANGE**2 / 2)) / RANGE
    apart = min(0.9, width / math.sqrt(4 * math.pi))
    cuts = max(1, math.ceil(math.log(max(rows, 1) / BLOCK_ROWS) / -math.log(apart)))
    return cuts, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together**cuts)))


def lines_of(dim: int, count: int, purpose: int, seed: int):
    import numpy as np

    return np.random.default_rng([seed, purpose, dim]).standard_normal((dim, count))


def block_keys(cuts: int, tables: int, deviation: float, seed: int):
    """Adds `blocks`: for each table the block of the row's vector."""

    def dealt(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys = [None] * batch.num_rows
            vectors, dims = batch.column("embedding"), batch.column("dim").to_pylist()
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                unit = vectors.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), dim)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                width = RANGE * deviation
                start = np.random.default_rng([seed, 2, dim]).uniform(0, width, cuts * tables)
                cells = np.floor((unit @ lines_of(dim, cuts * tables, 1, seed) + start) / width).astype(np.int64)
                cells = cells.reshape(len(at), tables, cuts)
                odd = np.random.default_rng([seed, 3, dim]).integers(1, 1 << 62, cuts) | 1
                mixed = (cells * odd).sum(axis=2) * 1000003 + np.arange(tables)
                for i, row in zip(at, mixed.tolist()):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "blocks"])

    return dealt


def compare_chunks(bound: float, deviation: float, need: int, lines: int, window: float, seed: int):
    """For one pair of chunks of a block: each row's links and the smallest id it is connected with there."""

    def compared(table):
        import numpy as np
        import pyarrow as pa

        first = table.slice(0, 1).to_pylist()[0]
        number, same = first["table"], first["left"] == first["right"]
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, -1)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        blocks = table.column("blocks").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        chunk = table.column("chunk").to_numpy()
        spots = vectors @ lines_of(vectors.shape[1], lines, 0, seed)
        half = window * deviation
        order = np.argsort(spots[:, 0], kind="stable")
        line = spots[order, 0]
        linked, found = np.zeros(len(ids), np.int64), ([], [])
        ends = np.searchsorted(line, line + SWEEP * deviation, side="right")
        for at in range(len(order)):  # the window's upper half: each pair is met once
            q, near = order[at], order[at + 1 : ends[at]]
            if not same:
                near = near[chunk[near] != chunk[q]]
            if not len(near):
                continue
            near = near[(np.abs(spots[near] - spots[q]) <= half).sum(axis=1) >= need]
            near = near[vectors[near] @ vectors[q] >= bound]
            # Pairs that share a block of an earlier table have been counted there.
            near = near[~(blocks[near, :number] == blocks[q, :number]).any(axis=1)]
            if len(near):
                linked[q] += copies[near].sum()
                linked[near] += copies[q]
                found[0].append(np.full(len(near), q))
                found[1].append(near)
        if not found[0]:
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        root = local_roots(len(ids), rank[np.concatenate(found[0])], rank[np.concatenate(found[1])])
        low = ids[by_id][root[rank]]
        some = linked > 0
        return pa.table({"rep": ids[some], "links": linked[some], "low": low[some]})

    return compared


def near_duplicate_vectors(vectors: DataFrame, bound: float = 0.98, lines: int = LINES, window: float = WINDOW,
                           recall: float = RECALL, seed: int = 11, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    deviation = math.sqrt(2 - 2 * bound)
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    norm = F.aggregate(as_double, F.lit(0.0), lambda a, x: a + x * x)
    usable = F.coalesce(finite & (norm > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label", usable.alias("usable"))
    distinct = materialize(
        rows.where("usable").groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies"))
        .withColumns({"dim": F.size("embedding"), "rep": F.monotonically_increasing_id()}),
        "embed-distinct",
    )
    # One figure for each label: the largest one sets how finely blocks are cut.
    most = distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cuts, tables = block_shape(most, deviation, recall)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    keyed = materialize(distinct.mapInArrow(block_keys(cuts, tables, deviation, seed), f"{fields}, blocks array<bigint>"), "embed-keys")
    dealt = keyed.select("label", "dim", "rep", F.posexplode("blocks").alias("table", "block"))
    held = dealt.groupBy("label", "dim", "table", "block").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    held = materialize(held, "embed-blocks")  # on its own, so that AQE can split a hot block
    full = keyed.select("label", "dim", "rep", "copies", "embedding", "blocks", F.posexplode("blocks").alias("table", "block"))
    full = full.join(held, ["label", "dim", "table", "block"])
    # A block of c chunks makes c(c + 1) / 2 tasks; a row takes part in c of them.
    chunks = F.ceil(F.col("n") / chunk)
    full = full.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("other")
    work = full.select("label", "dim", "table", "block", "chunk", "rep", "copies", "embedding", "blocks", other)
    work = work.withColumns({"left": F.least("chunk", "other"), "right": F.greatest("chunk", "other")})
    grouped = work.groupBy("label", "dim", "table", "block", "left", "right")
    need = needed_count(lines, window, recall)
    found = materialize(
        grouped.applyInArrow(compare_chunks(bound, deviation, need, lines, window, seed), "rep bigint, links bigint, low bigint"),
        "embed-links",
    )
    parts = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")), "embed")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = distinct.select("rep", "lowest").join(parts.withColumnRenamed("node", "rep"), "rep")
    # A component is known by a vector's number until here; ids may repeat, so they only name it.
    names = named.groupBy("component").agg(F.min("lowest").alias("name"))
    classes = (
        distinct.select("label", "embedding", "rep", "lowest", "copies")
        .join(links, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .join(names, "component", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("name", "lowest").alias("component_id"))
    )
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("usable").join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
