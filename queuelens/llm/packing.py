"""Best-fit packing of token sequences by swap-based local search.

Documents are tokenized, ended by one id, and only those longer than a sequence are cut. Pieces are
dealt by hash to groups of a fixed size, so groups grow in number, not in size. A group starts
from best fit decreasing; then, from the fullest underfull sequence on, a document of an emptier
sequence moves in, or is exchanged for one or two documents, so that the fuller one becomes as full as
possible. Every exchange increases the sum of squared fills, so the search ends; sequences that empty are
dropped. What stays underfull in all groups is dealt once more, until a round saves no sequence; that
round is not used.

Edge cases: NULL and empty texts are the end id alone; NULL and repeated ids are ordinary documents;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re

from pyspark.sql import DataFrame, functions as F

from queuelens.session import materialize

CAPACITY = 2048
END_ID = 0
#: Pieces of one group; more find better partners and take longer in one task.
GROUP = 4096
#: White-space runs of so many characters are encoded on their own: the pattern's look-ahead keeps a state for each
#: character of a run, and gives up beyond some hundred thousand.
LONG_RUN = 10_000
#: Unicode's white space, as the pattern's \s has it (Python's own \s takes four control characters more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids (numpy), from a tokenizers file (.json) or a rank file (.tiktoken) of the same vocabulary."""
    import numpy as np

    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        one = tiktoken.Encoding("run", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        long_run = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")

        def ids(encoding, text):
            return np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

        def encode(text):
            parts, at = [], 0
            for run in long_run.finditer(text):
                # The pattern leaves a run's last character to the word behind it.
                end = run.end() - (run.end() < len(text))
                parts += [ids(own, text[at : run.start()]), ids(one, text[run.start() : end])]
                at = end
            return np.concatenate([*parts, ids(own, text[at:])]) if parts else ids(own, text)

        return encode
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], deal): each document's pieces of at most `capacity` ids.

    A longer document's first piece takes what is over, so that all others are full. `deal` is a number that
    differs between repeated rows.
    """

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode, row = encoder(tokenizer), 0
        for batch in batches:
            of, out, ids = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = np.append(encode(text or ""), np.array([end_id], dtype="<u4"))
                edges = [0, *range((len(tokens) - 1) % capacity + 1, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    of.append(i)
                    out.append((k, a, b - a, zlib.crc32(tokens[a:b].tobytes()), row))
                    if keep_ids:
                        ids.append(tokens[a:b].astype("i4"))
                row += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int32()] + [pa.int64()] * 4)]
            extra = [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
            owner = batch.column("doc_id").take(pa.array(of, pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *["ids"] * keep_ids]
            yield pa.RecordBatch.from_arrays([owner, *columns, *extra], names)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(cut, shape).withColumn("deal", F.xxhash64("doc_id", "piece", "row")).drop("row")


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; an item goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r exists
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        by_room[room - size].append(at)
        rooms |= 1 << room - size
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins, each increasing the squared fill, until none is left or bins are as few as can be."""
    least = -(-sum(sizes) // capacity)
    fill = [sum(sizes[i] for i in b) for b in bins]
    home = {i: b for b, items in enumerate(bins) for i in items}
    while True:
        open_bins = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
        if sum(f > 0 for f in fill) <= least or len(open_bins) < 2:
            break
        pool: dict[int, set[int]] = {}
        present = 0  # bit s: an item of size s is in an emptier open bin

        def put(item):
            nonlocal present
            pool.setdefault(sizes[item], set()).add(item)
            present |= 1 << sizes[item]

        def take(item):
            nonlocal present
            pool[sizes[item]].discard(item)
            if not pool[sizes[item]]:
                present &= ~(1 << sizes[item])

        for b in open_bins:
            for i in bins[b]:
                put(i)
        queue = [(-fill[b], b) for b in open_bins]
        heapq.heapify(queue)
        done, changed = set(), False
        while queue:
            level, b = heapq.heappop(queue)
            if b in done or -level != fill[b] or not fill[b]:
                continue
            done.add(b)
            for i in bins[b]:
                take(i)
            while fill[b] < capacity:
                room, best, given = capacity - fill[b], 0, ()
                distinct = list({sizes[i]: i for i in bins[b]}.values())
                offers = [(), *((i,) for i in distinct)]
                seen = {sizes[i]: [] for i in distinct}
                for i in bins[b]:
                    seen[sizes[i]].append(i)
                for x, i in enumerate(distinct):
                    if len(seen[sizes[i]]) > 1:
                        offers.append(tuple(seen[sizes[i]][:2]))
                    offers.extend((i, j) for j in distinct[x + 1 :])
                for offer in offers:
                    out = sum(sizes[i] for i in offer)
                    reach = present & ((1 << min(out + room, capacity) + 1) - 1)
                    gain = reach.bit_length() - 1 - out
                    if gain > best:
                        best, given = gain, offer
                        if gain == room:
                            break
                if not best:
                    break
                size = best + sum(sizes[i] for i in given)
                item = next(iter(pool[size]))
                other = home[item]
                # Nothing is fuller than b among the open bins, so the squared fill rises.
                take(item)
                bins[other].remove(item)
                bins[b].append(item)
                home[item] = b
                for i in given:
                    bins[b].remove(i)
                    bins[other].append(i)
                    home[i] = other
                    put(i)
                fill[b] += best
                fill[other] -= best
                if fill[other]:
                    heapq.heappush(queue, (-fill[other], other))
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack_group(capacity: int):
    """Adds each piece's sequence of its group and its offset there, and whether that sequence is full."""

    def packed(table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("deal").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        sizes = table.column("length").to_pylist()
        whole = [i for i, s in enumerate(sizes) if s == capacity]
        parts = [i for i, s in enumerate(sizes) if s < capacity]
        own = [sizes[i] for i in parts]
        bins = local_search(best_fit_decreasing(own, capacity), own, capacity)
        bins = [[i] for i in whole] + [[parts[i] for i in b] for b in bins]
        place, offset, fill = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                place[i], offset[i] = b, at
                at += sizes[i]
            for i in items:
                fill[i] = at
        names = ["sequence", "offset", "fill"]
        for name, values in zip(names, (place, offset, fill)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return packed


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP,
         keep_ids: bool = False) -> DataFrame:
    """Each piece with sequence_id and offset: pieces of one sequence_id fill it gaplessly from 0."""
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pack-pieces")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    shape += ", group bigint, sequence bigint, offset bigint, fill bigint"
    left, done, open_ones, before = cut, [], None, None
    for number in itertools.count(1):
        n = left.count()
        groups = max(1, -(-n // group))
        dealt = left.withColumn("group", F.pmod(F.xxhash64(F.lit(number), "deal"), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInArrow(pack_group(capacity), shape), "pack-round")
        # A sequence's number: the round, the group, its place there.
        packed = packed.withColumn("sequence_id", F.col("sequence") + (F.col("group") + F.lit(number) * (1 << 31)) * (1 << 20))
        first, underfull = F.col("offset") == 0, F.col("fill") < capacity
        figures = packed.agg(
            F.count_if(first).alias("all"), F.count_if(first & underfull).alias("open"), F.sum(F.when(underfull, F.col("length"))).alias("ids")
        ).first()
        if before is not None and figures["all"] >= before:
            done.append(open_ones)
            break
        if groups == 1 or not figures.open or figures.open == -(-figures.ids // capacity):
            done.append(packed)
            break
        done.append(packed.where(~underfull))
        open_ones, before = packed.where(underfull), figures.open
        left = open_ones.select(*cut.columns)
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
