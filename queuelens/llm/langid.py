"""Language identification with word-first backoff.

A known word scores the logarithm of its frequency in each language. An unseen word falls back to
its longest known character n-grams (with word ends marked), and where none is known to shorter ones,
down to single characters. A document's language is the one with the highest sum over its words.

The model is fitted on a bounded number of documents for each language (`PER_LANG`). Every language brings
its own most frequent words and n-grams, at most `QUOTA` of each kind, so a language with few documents
keeps its place beside full ones and the model grows with the number of languages alone. Counts that are
equal are kept or left out together. Prediction reads whole texts.

Edge cases: NULL text and text without a letter is `und` with score 0, as is everything if no row is
labelled; equal scores go to the first language in order; repeated rows get equal rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from queuelens.session import materialize

#: Labelled documents of one language that the fit reads, about.
PER_LANG = 3000
#: Words, and n-grams, that one language brings into the model at most.
QUOTA = 25_000
LONGEST = 4
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    words: dict[str, int]  # row of `starts`
    grams: dict[str, int]
    starts: object  # where a row's cells begin, and the last one's end
    place: object  # language of each cell
    gain: object  # what a cell's count adds to the floor
    floor: object  # (2, langs): the score of a word, and of an n-gram, that a language lacks

    def _gained(self, rows: list[int]):
        import numpy as np

        total = np.zeros(len(self.langs))
        for at in rows:
            cells = slice(self.starts[at], self.starts[at + 1])
            total[self.place[cells]] += self.gain[cells]
        return total / len(rows)

    def word(self, word: str):
        """The word's score in each language."""
        at = self.words.get(word)
        if at is not None:
            return self.floor[0] + self._gained([at])
        marked = f"<{word}>"
        for n in range(LONGEST, 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i : i + n])) is not None]
            if known:
                return self.floor[1] + self._gained(known)
        return self.floor[1]


def count_grams(batches):
    """Words and marked n-grams of each batch's texts: (lang, kind, gram, n); kind 0 is a word."""
    import pyarrow as pa

    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        rows = []
        for lang, counts in words.items():
            grams: Counter = Counter()
            for word, c in counts.items():
                marked = f"<{word}>"
                for n in range(1, LONGEST + 1):
                    for i in range(len(marked) - n + 1):
                        grams[marked[i : i + n]] += c
            rows += [(lang, 0, w, c) for w, c in counts.items()] + [(lang, 1, g, c) for g, c in grams.items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "kind", "gram", "n"]
        )


def fit(labelled: DataFrame, per_lang: int = PER_LANG, quota: int = QUOTA) -> Model:
    """Fits on (doc_id, text, lang): about `per_lang` documents of each language, chosen by a hash of the id."""
    import numpy as np

    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = materialize(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")), "langid-counts")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(counts, "lang").where(draw < F.lit(float(per_lang)) / F.col("documents")).select("lang", "text")
    langs = tuple(sorted(r.lang for r in counts.select("lang").collect()))
    grams = sample.mapInArrow(count_grams, "lang string, kind int, gram string, n bigint")
    by_lang = materialize(grams.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")), "langid-grams")
    # From the most frequent down, as long as a language's quota holds all that are as frequent.
    sizes = by_lang.groupBy("kind", "lang", "n").agg(F.count(F.lit(1)).alias("grams"))
    so_far = F.sum("grams").over(Window.partitionBy("kind", "lang").orderBy(F.desc("n")))
    cuts = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= quota).groupBy("kind", "lang").agg(F.min("n").alias("least"))
    kept = by_lang.join(cuts, ["kind", "lang"]).where(F.col("n") >= F.col("least")).select("kind", "gram").distinct()
    rows = by_lang.join(kept, ["kind", "gram"]).groupBy("kind", "gram").agg(
        F.collect_list("lang").alias("langs"), F.collect_list("n").alias("n")
    )
    at = {lang: i for i, lang in enumerate(langs)}
    found: tuple[dict, dict] = ({}, {})
    starts, place, n = [0], [], []
    for r in rows.collect():
        found[r.kind][r.gram] = len(starts) - 1
        place += [at[lang] for lang in r.langs]
        n += r.n
        starts.append(len(n))
    totals = np.ones((2, len(langs)))
    for r in by_lang.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect():
        totals[r.kind, at[r.lang]] += r.n
    gain = np.log(np.array(n, np.float64) + 0.5) - math.log(0.5)
    return Model(langs, found[0], found[1], np.array(starts), np.array(place, np.int64), gain, math.log(0.5) - np.log(totals))


def predictor(model: Model, cache: int = 200_000):
    """Text to (language, score)."""
    import numpy as np

    seen: dict[str, object] = {}

    def predict(text: str | None) -> tuple[str, float]:
        counts = Counter(LETTERS.findall(text.lower())) if text else {}
        if not model.langs or not any(c.isalpha() for word in counts for c in word):
            return UNKNOWN, 0.0
        if len(seen) > cache:
            seen.clear()
        rows = []
        for word in counts:
            row = seen.get(word)
            if row is None:
                row = seen[word] = model.word(word)
            rows.append(row)
        n = np.fromiter(counts.values(), np.float64, len(counts))
        score = n @ np.array(rows)
        best = int(score.argmax())
        return model.langs[best], float(1 / np.exp(np.maximum(score - score[best], -700)).sum())

    return predict


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language and its share of the likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        predict = predictor(shared.value)
        for batch in batches:
            found = [predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a NULL id is in fold 0 like an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame, parts: int = 4, held: int = 2, **bounds) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learnt from the labelled rows of the other folds."""
    model = fit(docs.where(fold(F.col("doc_id"), parts) != held), **bounds)
    found = predict_languages(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "lang_pred", "score")
