"""How far the sources of one language differ in their words: iceberg prefix refinement, then shares and divergences.

The words that count are those in at least `min_docs` documents of their language. Most words are rare, so they are not
counted whole at first: byte prefixes are extended level by level (4, 8, 16, ... bytes), and a prefix in fewer
documents takes all its words out. A word no longer than the level is complete and is counted itself; the refinement ends
once all that is left is complete. Only the words that stay are then counted for each source, in a second pass over the texts.

A prefix must count a document once, however many of its words share it. A document's words are sorted, and each carries the
longest level at which it agrees with the word before it: a prefix's documents are the words with that prefix that agree with their
neighbour on less. These numbers are sums, so each run of documents is combined before anything is shuffled, and
taking words out never changes them, as whole prefixes go.

Shares are integers: 1 + floor(scale * (count + 1) / (total + words)). Sums over all pairs of sources come from tiles: a task
has some words and two tiles of sources as one matrix, and returns one sum for each pair. The pairs are the result, so
that part grows with the square of a language's sources; replication of the input is cut by the tile's size.

Edge cases: NULL text, lang and source are ''; every row is a document, repeated rows and ids too; a group without words
has the smallest share of each word; a language without kept words has pairs of value 0; a language with one source
has no pairs; words of any length are whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from queuelens.llm.common import numbered, runs
from queuelens.session import materialize

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Bytes of the first level; each further one is twice as long.
FIRST = 4
#: Runs of letters in lower-cased UTF-8.
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
#: Words and sources of one matrix, on average.
WORDS, SOURCES = 4096, 64


def words_of(text: bytes) -> list[bytes]:
    return LETTERS.findall(text)


def groups_of(batch, columns: list[str]):
    """(each row's group number, the groups' values for each column) of an Arrow batch."""
    import numpy as np

    groups: dict[tuple, int] = {}
    at = [groups.setdefault(values, len(groups)) for values in zip(*[batch.column(c).to_pylist() for c in columns])]
    return np.array(at, np.int64), list(zip(*groups))


def shared_levels(words: list[bytes], first: int):
    """For sorted words: for each level, the number of each word's prefix; up to the level at which no two words agree."""
    import numpy as np

    level, prefixes = first, []
    while True:
        cut = [w[:level] for w in words]
        new = np.fromiter((a != b for a, b in zip(cut[1:], cut)), bool, len(words) - 1)
        if new.all():
            return prefixes
        prefixes.append(np.concatenate([[0], np.cumsum(new)]))
        level *= 2


def document_counts(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """(lang, term, shared, docs): a run's documents for each word and level at which it agrees with the word before it."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lang, (names,) = groups_of(batch, ["lang"])
            for start, texts in runs(batch.column("text")):
                words, codes, sizes = numbered(texts, words_of)
                if not words:
                    continue
                order = sorted(range(len(words)), key=words.__getitem__)
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                words = [words[i] for i in order]
                # Each document's words once, in byte order.
                held = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(words) + rank[codes])
                doc, word = held // len(words), held % len(words)
                shared = np.zeros(len(held), np.int64)
                for number in shared_levels(words, first):
                    same = (doc[1:] == doc[:-1]) & (number[word[1:]] == number[word[:-1]])
                    shared[1:] += same  # a prefix that agrees does so on the levels before
                depth = int(shared.max()) + 1
                keys, n = np.unique((lang[start + doc] * len(words) + word) * depth + shared, return_counts=True)
                at, shared = keys // depth, keys % depth
                columns = [
                    pa.array(names, pa.string()).take(pa.array(at // len(words))), pa.array(words, pa.binary()).take(pa.array(at % len(words))),
                    pa.array(np.where(shared > 0, first << np.maximum(shared - 1, 0), 0)), pa.array(n.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "shared", "docs"])

    return docs.select("lang", "text").mapInArrow(counted, "lang string, term binary, shared bigint, docs bigint")


def occurrences(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n): a run's occurrences of each word in each group."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            group, names = groups_of(batch, ["lang", "source"])
            for start, texts in runs(batch.column("text")):
                words, codes, sizes = numbered(texts, words_of)
                if not words:
                    continue
                keys, n = np.unique(np.repeat(group[start : start + len(texts)], sizes) * len(words) + codes, return_counts=True)
                at = pa.array(keys // len(words))
                columns = [*[pa.array(c, pa.string()).take(at) for c in names], pa.array(words, pa.binary()).take(pa.array(keys % len(words)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], ["lang", "source", "term", "n"])

    return docs.mapInArrow(counted, "lang string, source string, term binary, n bigint")


def named(docs: DataFrame) -> DataFrame:
    """(lang, source, text), '' for NULL."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def frequent_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first: int = FIRST) -> DataFrame:
    """(lang, term) of the words in at least `min_docs` documents of their language."""
    left, level, complete = materialize(document_counts(named(docs), first), "term-docs"), first, None
    while True:
        cut = left.withColumn("prefix", F.substring("term", 1, level))
        news = F.when(F.col("shared") < level, F.col("docs")).otherwise(0)
        often = cut.groupBy("lang", "prefix").agg(F.sum(news).alias("seen")).where(F.col("seen") >= min_docs)
        left = materialize(cut.join(often, ["lang", "prefix"], "left_semi").drop("prefix"), f"terms-{level}")
        done = left.where(F.length("term") <= level)
        complete = done if complete is None else complete.union(done)
        left = left.where(F.length("term") > level)
        if left.isEmpty():
            break
        level *= 2
    seen = complete.groupBy("lang", "term").agg(F.sum("docs").alias("seen"))
    return seen.where(F.col("seen") >= min_docs).select("lang", "term")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first: int = FIRST) -> DataFrame:
    """(lang, source, term, n): occurrences of the frequent words, the only ones that are counted whole."""
    often = materialize(frequent_terms(docs, min_docs, first), "terms-frequent")
    counts = occurrences(named(docs)).join(often, ["lang", "term"], "left_semi").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return counts.withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, words: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / (total + words)), exact."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), total + words) + 1


def pair_sums(tile):
    """For two tiles of sources and some words: each ordered pair's sum of floor((p - q)^2 / q) over those words."""
    import numpy as np
    import pyarrow as pa

    lang, both = tile.column("lang")[0].as_py(), tile.column("left")[0].as_py() != tile.column("right")[0].as_py()
    sources = tile.column("source").combine_chunks().dictionary_encode()
    terms = tile.column("term").combine_chunks().dictionary_encode()
    at, word = sources.indices.to_numpy(), terms.indices.to_numpy(zero_copy_only=False)
    p, names = tile.column("p").to_numpy(), sources.dictionary.to_pylist()
    rest = tile.column("rest").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)  # a source's share of words that it lacks
    least = np.empty(len(names), np.int64)
    least[at[rest]] = p[rest]
    shares = np.repeat(least[:, None], len(terms.dictionary), axis=1)
    # Words of this part that no source of the two tiles has.
    others = tile.column("words").combine_chunks().filter(pa.array(rest))[0].as_py() - len(terms.dictionary)
    shares[at[~rest], word[~rest].astype(np.int64)] = p[~rest]
    side = np.empty(len(names), np.int64)
    side[at] = tile.column("tile").to_numpy()
    out = []
    for i, name in enumerate(names):
        sums = ((shares - shares[i]) ** 2 // shares).sum(axis=1) + others * ((least - least[i]) ** 2 // least)
        out += [(lang, name, names[j], int(sums[j])) for j in range(len(names)) if j != i and not (both and side[i] == side[j])]
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.table({"lang": pa.array(columns[0], pa.string()), "source": pa.array(columns[1], pa.string()),
                     "item": pa.array(columns[2], pa.string()), "value": pa.array(columns[3], pa.int64())})


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, words: int = WORDS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source, `term` rows for the `top` overused words."""
    counts = materialize(kept_terms(docs, min_docs), "terms-kept")
    groups = named(docs).select("lang", "source").distinct()
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = in_lang.groupBy("lang").agg(F.count("*").alias("words"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    sizes = materialize(sizes, "term-totals")
    known = counts.join(sizes, ["lang", "source"])

    p, q = share(F.col("n"), F.col("total"), F.col("words")), share(F.col("lang_n"), F.col("lang_total"), F.col("words"))
    over = known.join(in_lang, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    gap = F.col("p") - F.col("q")
    over = over.where(gap > 0).select("lang", "source", F.lit("term").alias("part"), "item", F.call_function("div", gap * gap, F.col("q")).alias("value"))

    tiles = sizes.groupBy("lang").agg(F.ceil(F.count("*") / sources).alias("tiles"))
    placed = sizes.join(tiles, "lang").withColumns({
        "tile": F.pmod(F.xxhash64("source"), "tiles"), "chunks": F.greatest(F.lit(1), F.ceil(F.col("words") / words)),
    })
    lacking = F.when(F.col("words") > 0, share(F.lit(0), F.col("total"), F.greatest("words", F.lit(1)))).otherwise(1)
    rest = placed.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), lacking.alias("p"), F.lit(True).alias("rest"), "tile", "tiles",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"),
    )
    chunks = placed.select("lang", "chunks").distinct()
    in_chunk = in_lang.join(chunks, "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "chunks").alias("chunk")).agg(F.count("*").alias("words"))
    rest = rest.join(in_chunk, ["lang", "chunk"], "left").na.fill(0, ["words"]).select(
        "lang", "source", "term", "p", "rest", "tile", "tiles", "chunk", "words"
    )
    held = counts.join(placed, ["lang", "source"]).select(
        "lang", "source", "term", p.alias("p"), F.lit(False).alias("rest"), "tile", "tiles", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"),
        F.lit(None).cast("bigint").alias("words"),
    )
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other")
    cells = held.union(rest).select("*", other).withColumns({"left": F.least("tile", "other"), "right": F.greatest("tile", "other")})
    summed = cells.groupBy("lang", "chunk", "left", "right").applyInArrow(pair_sums, "lang string, source string, item string, value bigint")
    pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).union(over.withColumn("rank", rank).where(F.col("rank") <= top))
