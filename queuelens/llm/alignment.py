"""Token alignment of two tokenizers over the same texts.

Both sides' tokens are byte ranges of one string. In each batch, pandas' merge_asof, keyed by document, finds for every token start the
other side's token that covers it. Of two tokens that overlap, the later start lies in the other token, so both
directions together hold every overlap; overlaps with equal ends cut the string into groups. Tokens of one group
are linked with each other.

How many documents link a pair of ids is counted over the corpus: each document's distinct pairs are stored, counted with
map-side combining, and joined back by the pair, so neither a frequent pair nor a long document is one task's work.
A pair is one number, and no more than the product of the vocabularies can occur.

Edge cases: NULL and empty texts, and texts that one side can't give back byte for byte (a normalising tokenizer, a
literal U+2581), have no tokens and zeros; long texts are whole, searched in windows of rows; NULL and repeated ids
are documents of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window, functions as F

from queuelens.llm.packing import encoder
from queuelens.session import materialize

#: Characters that are aligned at once, if no single text is longer, and rows of one search.
BATCH, ROWS = 1 << 19, 1 << 18
#: Links of one group that are written out one by one; larger groups count equal ids first.
PLAIN = 1 << 12


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a rank file (.tiktoken), a byte-level tokenizers file (.json) or a sentencepiece model."""
    if path.endswith(".tiktoken"):
        import base64

        with open(path, "rb") as lines:
            ranks = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    elif path.endswith(".json"):
        from tokenizers import Tokenizer

        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = [(i, bytes(map(letters.__getitem__, t))) for t, i in Tokenizer.from_file(path).get_vocab().items()]
    else:
        pieces = sentence_pieces(path)
        ranks = []
        for i in range(pieces.get_piece_size()):
            piece = pieces.id_to_piece(i)
            ranks.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
    table = [b""] * (1 + max(i for i, _ in ranks))
    for i, token in ranks:
        table[i] = token
    return table


@functools.lru_cache(maxsize=2)
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def covering(at, doc, other_at, other_doc, rows: int = ROWS):
    """For each start in `at` the number of the other side's token that covers it; both sides in the order of the string."""
    import numpy as np
    import pandas as pd

    found = [np.empty(0, np.int64)]
    for a in range(0, len(at), rows):
        b = min(a + rows, len(at))
        low = max(0, np.searchsorted(other_at, at[a], side="right") - 1)
        high = np.searchsorted(other_at, at[b - 1], side="right")
        left = pd.DataFrame({"at": at[a:b], "doc": doc[a:b]})
        right = pd.DataFrame({"at": other_at[low:high], "doc": other_doc[low:high], "token": np.arange(low, high)})
        found.append(pd.merge_asof(left, right, on="at", by="doc", direction="backward")["token"].to_numpy(np.int64))
    return np.concatenate(found)


def group_cuts(size_a, size_b, doc_a, doc_b):
    """For each side, which tokens end a group: they overlap a token of the other side with the same end."""
    import numpy as np

    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start_a, start_b = end_a - size_a, end_b - size_b
    over_a = np.concatenate([np.arange(len(size_a)), covering(start_b, doc_b, start_a, doc_a)])
    over_b = np.concatenate([covering(start_a, doc_a, start_b, doc_b), np.arange(len(size_b))])
    same = end_a[over_a] == end_b[over_b]
    cut_a, cut_b = np.zeros(len(size_a), bool), np.zeros(len(size_b), bool)
    cut_a[over_a[same]], cut_b[over_b[same]] = True, True
    return cut_a, cut_b


def linked_pairs(a, b, group_a, group_b, width: int, doc_of_group):
    """(document * pairs + pair, links) of every document's distinct id pairs; pair = a * width + b."""
    import numpy as np

    many_a, many_b = np.bincount(group_a), np.bincount(group_b)
    first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    plain = many_a * many_b <= PLAIN
    times = np.where(plain[group_a], many_b[group_a], 0)
    rows = np.repeat(np.arange(len(a)), times)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    pair = a[rows] * width + b[first_b[group_a[rows]] + nth]
    keys, links, docs = [pair], [np.ones(len(pair), np.int64)], [doc_of_group[group_a[rows]]]
    for g in np.flatnonzero(~plain).tolist():
        ids_a, n_a = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
        keys.append(np.add.outer(ids_a * width, ids_b).ravel())
        links.append(np.multiply.outer(n_a, n_b).ravel())
        docs.append(np.full(len(keys[-1]), doc_of_group[g]))
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(links)


@functools.lru_cache(maxsize=2)
def decimals(width: int):
    """The digits of all numbers of up to `width` digits as bytes, zero behind them, and how many each has."""
    import numpy as np

    text = np.arange(10**width).astype(f"S{width}")
    return text.view(np.uint8).reshape(-1, width), np.char.str_len(text)


def written_groups(a, b, group_a, group_b, last_a, last_b):
    """The groups as ASCII bytes, `a1,a2|b1;...;`, and the place where each token's bytes end, in writing order."""
    import numpy as np

    count_a, count_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    place_a = np.arange(len(a)) + np.concatenate([[0], count_b])[group_a]
    place_b = np.arange(len(b)) + count_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    digits, lengths = decimals(len(str(ids.max(initial=0))))
    sizes, width = lengths[ids], digits.shape[1]
    cells = np.zeros((len(ids), width + 1), np.uint8)
    cells[:, :width] = digits[ids]
    cells[np.arange(len(ids)), sizes] = mark
    return cells[cells > 0], np.cumsum(sizes + 1), place_b


def align_texts(texts: list[str | None], tokenizer_a: str, tokenizer_b: str) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of each text."""
    import hashlib

    import numpy as np

    bytes_a, bytes_b = token_bytes(tokenizer_a), token_bytes(tokenizer_b)
    encode, found = encoder(tokenizer_a), [(0, 0, 0, 0, "", [], [])] * len(texts)
    ids_b = sentence_pieces(tokenizer_b).encode([t or "" for t in texts], num_threads=1)
    at, a, b = [], [], []
    for i, text in enumerate(texts):
        if text:
            spaced = " " + text
            of_a, whole = encode(spaced), spaced.encode()
            if b"".join(map(bytes_b.__getitem__, ids_b[i])) == whole == b"".join(map(bytes_a.__getitem__, of_a.tolist())):
                at.append(i)
                a.append(of_a.astype(np.int64))
                b.append(np.array(ids_b[i], np.int64))
    if not at:
        return found
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    a, b, doc_a, doc_b = np.concatenate(a), np.concatenate(b), np.repeat(np.arange(len(at)), n_a), np.repeat(np.arange(len(at)), n_b)
    sizes_a, sizes_b = _sizes(tokenizer_a), _sizes(tokenizer_b)
    last_a, last_b = group_cuts(sizes_a[a], sizes_b[b], doc_a, doc_b)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    doc_of_group = doc_a[last_a]
    groups = np.bincount(doc_of_group, minlength=len(at))
    links = np.zeros(len(at), np.int64)
    np.add.at(links, doc_of_group, np.bincount(group_a) * np.bincount(group_b))

    docs, pair, times = linked_pairs(a, b, group_a, group_b, len(bytes_b), doc_of_group)
    order = np.lexsort((pair, docs))
    docs, pair, times = docs[order], pair[order], times[order]
    new = np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(pair) != 0)])
    starts = np.flatnonzero(new)
    docs, pair, times = docs[starts], pair[starts], np.add.reduceat(times, starts)
    edges = np.searchsorted(docs, np.arange(len(at) + 1))

    flat, ends, place_b = written_groups(a, b, group_a, group_b, last_a, last_b)
    stops = ends[place_b[np.cumsum(n_b) - 1]]
    for k, i in enumerate(at):
        text = flat[stops[k - 1] if k else 0 : stops[k] - 1].tobytes()
        part = slice(edges[k], edges[k + 1])
        found[i] = (int(n_a[k]), int(n_b[k]), int(groups[k]), int(links[k]), hashlib.sha256(text).hexdigest(), pair[part], times[part])
    return found


@functools.lru_cache(maxsize=4)
def _sizes(path: str):
    import numpy as np

    return np.array([len(t) for t in token_bytes(path)], np.int64)


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, batch: int = BATCH) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row."""

    def cut(batches):
        import pyarrow as pa

        types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
        for rows in batches:
            texts, at = rows.column("text"), 0
            sizes = [len(t.as_py() or "") for t in texts]
            while at < len(sizes):
                end, size = at + 1, sizes[at]
                while end < len(sizes) and size + sizes[end] <= batch:
                    size += sizes[end]
                    end += 1
                found = list(zip(*align_texts(texts.slice(at, end - at).to_pylist(), tokenizer_a, tokenizer_b)))
                columns = [pa.array(c, t) for c, t in zip(found, types)]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(at, end - at), *columns], names)
                at = end

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        cut, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    )


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    width = len(token_bytes(tokenizer_b))
    stored = materialize(aligned(docs, tokenizer_a, tokenizer_b).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    counted = stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    # One id has at most the other vocabulary's size of pairs.
    most = F.max("docs").over(Window.partitionBy(F.call_function("div", F.col("pair"), F.lit(width))))
    counted = materialize(counted.select("pair", "docs", (F.col("docs") == most).alias("best")), "pair-counts")
    each = stored.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("uid", F.col("p.pairs").alias("pair"), "p.times")
    sums = each.join(counted, "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    kept = stored.select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    full = kept.join(sums, "uid", "left").na.fill(0, ["n_best", "count_sum"])
    return full.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
