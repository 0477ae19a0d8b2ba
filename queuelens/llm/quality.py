"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a fixed list of figures (shares of byte classes, repetition of words and lines,
lengths). Every figure is cut into bins, and shallow trees are boosted in a cycle, each on one figure
alone, so their sum is a lookup table for each figure. The pairs whose coarse grid still explains most
of the gradient then get tables of their own. A score is the logistic of one addition per table.

The fit uses about `MAX_TRAIN` labelled rows, chosen by a hash of the id; figures and scores cover every
row and its whole text. Labels, languages, sources and ids are never figures.

Edge cases: NULL text counts as empty and is scored like any other; a document labelled more than once has
the mean label, 1 on a tie; labels other than 0 and 1 and labels without a document are ignored; without
labels every score is 0.5; repeated rows get equal rows; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from queuelens.llm.common import keep_matching
from queuelens.llm.langid import fold
from queuelens.session import materialize

#: Labelled rows that the fit reads, about.
MAX_TRAIN = 20_000
THRESHOLD = 0.3
BINS = 64
GRID = 12
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
FIGURES = (
    "chars", "words", "word_length", "upper", "lower", "digits", "spaces", "stops", "marks", "brackets", "other_ascii",
    "beyond_ascii", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "no_letter_words", "marked_words",
    "capitalised", "upper_words", "lines", "line_length", "short_lines", "ended_lines", "distinct_lines", "compressed",
)


def byte_classes():
    import numpy as np

    classes = np.zeros((256, 9))
    groups = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\f\n", b".,;:'\"-", b"!?", b"()[]{}<>|/\\")
    for k, group in enumerate(groups):
        classes[list(group), k] = 1
    classes[:128, 7] = classes[:128].sum(axis=1) == 0
    classes[128:, 8] = 1
    return classes


def figures(text: str | None, classes) -> list[float]:
    """The values of FIGURES for one text."""
    import zlib
    from collections import Counter

    import numpy as np

    text = text or ""
    data = text.encode()
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ classes / max(len(data), 1)).tolist()
    words = text.split()
    counts = Counter(words)
    n, kinds = max(len(words), 1), list(counts)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    of = lambda test: sum(c for w, c in counts.items() if test(w)) / n
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / n, *shares,
        len(kinds) / n, max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words[1:], words)) / n, len(set(zip(words, words[1:]))) / n,
        of(lambda w: not any(map(str.isalpha, w))), of(lambda w: not w[-1].isalnum() and w[-1] not in ".,"),
        of(lambda w: w[0].isupper()), of(lambda w: len(w) > 1 and w.isupper()),
        math.log1p(len(lines)), math.log1p(sum(map(len, lines)) / m), sum(len(x) < 40 for x in lines) / m,
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / m, len(set(lines)) / m,
        len(zlib.compress(data, 1)) / max(len(data), 1),
    ]


def with_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, figures array<float>) of every row."""

    def measured(batches):
        import pyarrow as pa

        classes = byte_classes()
        for batch in batches:
            rows = [figures(t, classes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(rows, pa.list_(pa.float32()))],
                ["doc_id", "text_hash", "figures"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measured, f"doc_id {kind}, text_hash bigint, figures array<float>")


@dataclass(frozen=True)
class Additive:
    """base + one table entry for each figure's bin and each pair's bins."""

    base: float
    cuts: tuple
    tables: tuple
    coarse: tuple
    pairs: tuple[tuple[int, int], ...]
    grids: tuple

    def logit(self, x):
        import numpy as np

        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            out += table[np.searchsorted(cuts, x[:, f], side="right")]
        for (f, g), grid in zip(self.pairs, self.grids):
            out += grid[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return out

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def cut_points(values, bins: int):
    """Inner edges of at most `bins` bins of near equal counts."""
    import numpy as np

    if not len(values):
        return np.zeros(0)
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def tree(gradient, weight, leaves: int = 3, ridge: float = 1.0):
    """A tree over ordered bins: steps that lower the loss most, split by split."""
    import numpy as np

    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    edges = [0, len(gradient)]
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(edges, edges[1:]):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            left, right = (g[k] - g[a]) ** 2 / (h[k] - h[a] + ridge), (g[b] - g[k]) ** 2 / (h[b] - h[k] + ridge)
            gain = left + right - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
            if gain.max() > best:
                best, at = gain.max(), int(k[gain.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def quadrants(gradient, weight, ridge: float = 1.0):
    """(gain, steps) of the best tree that cuts a grid once along each figure."""
    import numpy as np

    def four(x):
        c = np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        inner = c[1:-1, 1:-1]
        a, b, whole = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return np.stack([inner, a - inner, b - inner, whole - a - b + inner])

    out = np.zeros(gradient.shape)
    if min(gradient.shape) < 2:
        return 0.0, out
    g, h = four(gradient), four(weight)
    gain = (g**2 / (h + ridge)).sum(axis=0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    step = g[:, i, j] / (h[:, i, j] + ridge)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j] - gradient.sum() ** 2 / (weight.sum() + ridge)), out


def fit_rows(x, y, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Additive:
    """Fits figures x (n, figures) to labels y (0 or 1)."""
    import numpy as np

    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share))) if n else 0.0
    cuts = tuple(cut_points(x[:, f], BINS) for f in range(width))
    coarse = tuple(cut_points(x[:, f], GRID) for f in range(width))
    fine = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds if n else 0):
        for f in range(width):
            g, h = slopes()
            size = len(tables[f])
            step = rate * tree(np.bincount(fine[f], g, size), np.bincount(fine[f], h, size))
            tables[f] += step
            z += step[fine[f]]
    chosen: list[tuple[int, int]] = []
    grids: list = []
    if n:
        g, h = slopes()
        shape = [len(c) + 1 for c in coarse]
        cell = lambda f, k: rough[f] * shape[k] + rough[k]
        grid = lambda v, f, k: np.bincount(cell(f, k), v, shape[f] * shape[k]).reshape(shape[f], shape[k])
        gains = {p: quadrants(grid(g, *p), grid(h, *p))[0] for p in itertools.combinations(range(width), 2)}
        chosen = sorted(sorted(gains, key=gains.get, reverse=True)[:pairs])
        grids = [np.zeros((shape[f], shape[k])) for f, k in chosen]
        for _ in range(pair_rounds):
            for at, p in enumerate(chosen):
                g, h = slopes()
                step = rate * quadrants(grid(g, *p), grid(h, *p))[1]
                grids[at] += step
                z += step[rough[p[0]], rough[p[1]]]
    return Additive(base, cuts, tuple(tables), coarse, tuple(chosen), tuple(grids))


def fit(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Additive:
    """Fits on about `max_rows` of the rows of `measured` that `labels` (doc_id, quality) marks.

    Where marked ids repeat with many texts there may be more rows, about twice `max_rows` at most.
    """
    import numpy as np

    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    n = marked.count()
    draw = lambda *by: F.pmod(F.xxhash64(F.lit("quality"), *by), F.lit(1 << 30)) / float(1 << 30)
    chosen = materialize(marked.where(draw("doc_id") < min(1.0, max_rows / max(n, 1))), "quality-labels")
    rows = measured.join(chosen, "doc_id").groupBy("doc_id", "text_hash").agg(F.first("figures").alias("figures"), F.first("good").alias("good"))
    rows = materialize(rows, "quality-rows")
    rows = rows.where(draw("doc_id", "text_hash") < min(1.0, 2 * max_rows / max(rows.count(), 1)))
    rows = sorted((r.doc_id, r.text_hash, r.figures, r.good) for r in rows.collect())
    x = np.array([r[2] for r in rows], dtype=np.float32).reshape(len(rows), len(FIGURES))
    return fit_rows(x, np.array([float(r[3]) for r in rows]))


def score_rows(measured: DataFrame, model: Additive) -> DataFrame:
    """Adds `score` to (doc_id, text_hash, figures)."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = batch.column("figures").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FIGURES))
            names = ["doc_id", "text_hash", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.score(x).astype(np.float64))], names)

    kind = measured.schema["doc_id"].dataType.simpleString()
    return measured.mapInArrow(scored, f"doc_id {kind}, text_hash bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, parts: int = 5, held: int = 0,
             max_rows: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted) of every row, learnt from the labels of the other folds."""
    measured = materialize(with_figures(docs), "quality-figures")
    model = fit(measured, labels.where(fold(F.col("doc_id"), parts) != held), max_rows)
    return score_rows(measured, model).select(
        "doc_id", "text_hash", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are predicted to be good, with all their columns."""
    good = classify(docs, labels, **options).where("predicted = 1").select("doc_id", "text_hash").distinct()
    return keep_matching(docs, good, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text")})
