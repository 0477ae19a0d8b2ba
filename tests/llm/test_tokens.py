"""Source divergence, language-model scores, token alignment; repeated vector ids and long runs of white space."""

import bisect
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from queuelens.llm import alignment, divergence, embed_dedup, packing, pitman_yor
from queuelens.llm.queries import PIECES, QUERIES, TOKENIZER, table
from tests.llm import brute

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, `_row` int, word int"
JSON = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 7, 1, 2) for r in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "b"), (None, "a b c", "en", "a"), (None, None, None, "a"), (3, "a b c", "en", "a"),
       (3, "a b c", "en", "a"), (4, "word " * 60_000, None, "b"), (5, " \n\t", "de", ""), (6, "ünï çödé 123 !! ÄB", "fr", "é"),
       (7, "x" * 300_000 + " A b", "en", "c"), (8, "x" * 300_000 + "y a", "en", "c"), (9, "x" * 299_999 + " a", "en", "a"), (10, "z\x00z", "en", "z")]


# --- source divergence


def divergence_rows(rows, min_docs=3, top=200):
    import re

    words = lambda t: [m.lower() for m in re.findall(rb"[A-Za-z\x80-\xff]+", (t or "").encode())]
    rows = [(lang or "", source or "", words(text)) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        often = Counter(w for r in mine for w in set(r[2]))
        kept = sorted(w for w, n in often.items() if n >= min_docs)
        count = {s: Counter(w for r in mine if r[1] == s for w in r[2]) for s in {r[1] for r in mine}}
        count[None] = sum(count.values(), Counter())
        total = {s: sum(c[w] for w in kept) for s, c in count.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (total[s] + len(kept)) for w in kept} for s, c in count.items()}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in [s for s in count if s is not None]:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in count if t not in (s, None)]
            terms = [(w.decode(), f(p[s][w], p[None][w])) for w in kept if count[s][w] and p[s][w] > p[None][w]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:last])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"words": 3, "sources": 1}])
def test_divergence(spark, options):
    rng = np.random.default_rng(2)
    names = ["a", "ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "Abcdefghij" * 4, "ébc", "öffnung", "zz"] + [f"r{'abcdefghij'[i % 10] * (i + 1)}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(0, 12)), p=None)), str(rng.choice(["en", "de"])), str(rng.choice(list("stuvé")))) for i in range(60)]
    for docs in (ODD, rows, rows + ODD):
        got = sorted(tuple(r) for r in divergence.divergences(docs_of(spark, docs), **options).collect())
        assert got == divergence_rows(docs)
    assert divergence.divergences(docs_of(spark, [])).count() == 0


def test_few_top_words(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, sf, "documents").collect()]
    got = sorted(tuple(r) for r in divergence.divergences(table(spark, sf, "documents"), min_docs=2, top=5).collect())
    assert got == divergence_rows(rows, 2, 5)


# --- language-model scores


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def lm_base(rows):
    learnt = Counter(t for i, text in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(learnt.values()), len(learnt)
    return n, sorted((i or 0, len(tokens(t)), sum(w in learnt for w in tokens(t)),
                      round(sum(math.log10((learnt[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)


def test_lm_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD]
    got = pitman_yor.score_corpus(docs_of(spark, ODD)).collect()
    n, expected = lm_base(rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.train_tokens == n and r.score <= 0 and math.isfinite(r.score) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert pitman_yor.score_corpus(docs_of(spark, [])).count() == 0
    # Nothing to learn from: one unknown word, which is certain.
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = pitman_yor.score_corpus(docs_of(spark, [(held, "a b", "en", "s")])).first()
    assert (alone.held_out, alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score, alone.score) == (True, 3, 0, 0, 0.0, 0.0)


def plain_probability(model, words, sample):
    """P(word | context) by the definition, from collected seats."""
    d2, d1, d0 = model.discounts
    t, k = model.samples[sample], model.strength
    seats = {bytes(r["word"]): r for r in words}
    none = {"ctx": [], "n": [], f"t2_{sample}": [], f"t1_{sample}": [], f"t0_{sample}": 0}

    def probability(word, context):
        r = seats.get(word, none)
        low = sorted({c >> 8 for c in r["ctx"]})
        t1 = dict(zip(low, r[f"t1_{sample}"]))
        t2 = dict(zip(r["ctx"], r[f"t2_{sample}"]))
        n = dict(zip(r["ctx"], r["n"]))
        c1 = {v: sum(x for c, x in t2.items() if c >> 8 == v) for v in low}
        v = context >> 8
        p = (max(sum(t1.values()) - d0 * r[f"t0_{sample}"], 0) + (k + d0 * t.tables0) / (model.types + 1)) / (k + t.customers0)
        p = (max(c1.get(v, 0) - d1 * t1.get(v, 0), 0) + (k + d1 * t.tables1[v]) * p) / (k + t.customers1[v])
        return (max(n.get(context, 0) - d2 * t2.get(context, 0), 0) + (k + d2 * t.tables2[context]) * p) / (k + t.customers2[context])

    return probability


def test_lm_scores_by_the_definition(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 60")
    model = pitman_yor.train(docs.where(~pitman_yor.held_out(F.col("doc_id"))), samples=2, burn=1)
    words = model.words.collect()
    ways = [plain_probability(model, words, i) for i in range(2)]
    after = lambda w: w[-1] << 8 | (w[-2] if len(w) > 1 else 0x20) if w else pitman_yor.START
    got = {r.doc_id: r for r in pitman_yor.score_documents(docs, model).collect()}
    for r in docs.collect():
        before = [b"", *tokens(r.text)]
        score = sum(math.log10(sum(p(w, after(b)) for p in ways) / 2) for b, w in zip(before, before[1:]))
        assert got[r.doc_id].score == pytest.approx(score)
    # Each context's probabilities, the unknown word's among them, add up to one.
    for context in (pitman_yor.START, after(b"the"), after(b"q"), 0):
        for p in ways:
            assert sum(p(w, context) for w in [*[bytes(r["word"]) for r in words], b" "]) == pytest.approx(1)
    # Seats: at least one table, at most one for each customer, and the totals are their sums.
    for r in words:
        for i in range(2):
            assert all(1 <= t <= n for t, n in zip(r[f"t2_{i}"], r["n"]))
            assert 1 <= r[f"t0_{i}"] <= sum(r[f"t1_{i}"]) <= sum(r[f"t2_{i}"])
    assert model.samples[1].customers0 == sum(sum(r["t1_1"]) for r in words)
    assert model.tokens == sum(sum(r["n"]) for r in words)


def test_lm_seats_travel_as_one_run_of_integers(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 60")
    model = pitman_yor.train(docs, samples=2, burn=1)
    # No list is taken apart between the sweeps and the scores.
    assert [f.dataType.simpleString() for f in model.seats.schema.fields] == ["binary", "bigint", "binary"]
    assert dict(pitman_yor.word_rows(docs).dtypes)["entries"] == "binary"
    m, u, context, n = np.array([2, 0, 1]), np.array([1, 0, 1]), np.array([5, 6, 700]), np.array([3, 1, 1])
    seatings = [(n + i, np.array([2, 1]) + i, np.array([1, 0, 1]) * (i + 1)) for i in range(2)]
    column = pitman_yor.pack(m, u, context, n, seatings)
    column = pa.array([None, *[x.as_py() for x in column]], column.type)
    *lists, kept = pitman_yor.unpack(column, 2)
    for got, expected in zip(lists, ([0, *m], [0, *u], context, [1, 1, 3], n)):
        assert got.tolist() == list(expected)
    for got, (t2, t1, t0) in zip(kept, seatings):
        assert [x.tolist() for x in got] == [t2.tolist(), t1.tolist(), [0, *t0]]


def test_lm_beats_its_base_on_held_out_documents_and_reruns_agree(spark, sf):
    rows = QUERIES["op12_lm_scoring"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    again = QUERIES["op12_lm_scoring"](spark, sf).repartition(3).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in rows) == sorted((r.doc_id, round(r.score, 6)) for r in again)
    assert lm_base([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])[1] == sorted(
        (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows
    )


def test_seats_follow_the_restaurant():
    n = 4000
    keys = np.random.default_rng(3).integers(0, 1 << 63, n).astype(np.uint64)
    for customers, p in ((2, 0.3), (5, 0.1), (400, 0.05)):
        got = pitman_yor.seated(np.full(n, customers), np.full(n, 10), np.full(n, p), 0.6, 1.0, keys)
        rng, slow = np.random.default_rng(1), []
        for _ in range(n):
            k = 1
            for done in range(1, customers):
                new = (1.0 + 0.6 * (10 + k)) * p
                k += rng.random() < new / (done - 0.6 * k + new)
            slow.append(k)
        assert got.mean() == pytest.approx(np.mean(slow), rel=0.05)


# --- token alignment


def alignment_rows(texts):
    one = Tokenizer.from_file(JSON)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bytes_a, bytes_b = alignment.token_bytes(JSON), alignment.token_bytes(PIECES)
    held, in_docs = [], Counter()
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a, b = one.encode(" " + (text or ""), add_special_tokens=False).ids, two.encode(text or "")
        if not text or {b"".join(bytes_a[i] for i in a), b"".join(bytes_b[i] for i in b)} != {spaced}:
            held.append(([], [], [], Counter()))
            continue
        end_a, end_b = np.cumsum([len(bytes_a[i]) for i in a]).tolist(), np.cumsum([len(bytes_b[i]) for i in b]).tolist()
        ends, groups = sorted({*end_a} & {*end_b}), defaultdict(lambda: ([], []))
        for side, ids, at in ((0, a, end_a), (1, b, end_b)):
            for i, e in zip(ids, at):
                groups[bisect.bisect_left(ends, e)][side].append(i)
        parts = [groups[g] for g in range(len(ends))]
        links = Counter()
        for x, y in parts:
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    links[i, j] += n * m
        held.append((a, b, parts, links))
        in_docs.update(links.keys())
    best = Counter()
    for (i, _), n in in_docs.items():
        best[i] = max(best[i], n)
    for a, b, parts, links in held:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        yield (len(a), len(b), len(parts), sum(links.values()), sum(n for k, n in links.items() if in_docs[k] == best[k[0]]),
               sum(n * in_docs[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else "")


def test_alignment(spark, sf, monkeypatch):
    texts = [r.text for r in table(spark, sf, "documents").limit(150).collect()] + [r[1] for r in ODD]
    texts += [" ", "  a", "<|endoftext|> x </s> <s>", "\u2581a", "<0x41> \x00", "é" * 50, "日本語 🎉🎉", " " * 3000, "=-" * 3000, "\r\n\t", "ﬁ"]
    docs = docs_of(spark, [(i if i % 5 else None, t, None, None) for i, t in enumerate(texts)])
    got = alignment.align(docs, TOKENIZER, PIECES).collect()
    expected = Counter((i if i % 5 else None, *row) for i, row in enumerate(alignment_rows(texts)))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == expected
    assert alignment.align(docs.limit(0), TOKENIZER, PIECES).count() == 0


def test_small_windows_find_the_same_cover():
    rng = np.random.default_rng(4)
    a, b = (np.cumsum(rng.integers(1, 4, n)) for n in (500, 700))
    b = b[b <= a[-1]]
    a, b = np.append(0, a[:-1]), np.append(0, b[:-1])
    same = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    whole = alignment.covering(a, same[0], b, same[1])
    assert (whole == np.searchsorted(b, a, side="right") - 1).all()
    assert (alignment.covering(a, same[0], b, same[1], rows=7) == whole).all()


# --- long runs of white space, repeated vector ids


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u3000"])
def test_long_white_space_has_the_ids_of_the_tokenizers_file(space):
    fast, plain = packing.encoder(TOKENIZER), packing.encoder(JSON)
    for n in (9_999, 10_001, 100_000):
        for text in (space * n, "ab" + space * n + "cd 1", "x " + space * n + "\tword" + space * n):
            assert np.array_equal(fast(text), plain(text))
    text = "a" + space * 1_000_000 + "b"
    assert np.array_equal(fast(text), plain(text))


def test_packing_survives_long_white_space(spark):
    texts = ["a" + " " * 1_500_000 + "b", "\n" * 1_000_000]
    rows = packing.pack(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), TOKENIZER).collect()
    plain = packing.encoder(JSON)
    assert [sum(r.length for r in rows if r.doc_id == i) for i in range(2)] == [len(plain(t)) + 1 for t in texts]


def test_repeated_vector_ids_connect_nothing(spark):
    rng = np.random.default_rng(6)
    u, v, w, x = (rng.standard_normal(16).tolist() for _ in range(4))
    near = (np.array(v) + 0.01 * rng.standard_normal(16)).tolist()
    rows = [(1, u, "A"), (1, v, "A"), (3, w, "A"), (3, x, "B"), (4, near, "A"), (5, x, "B")]
    got = embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 0, 1), (1, 1, 1), (3, 0, 3), (3, 1, 3), (4, 1, 1), (5, 1, 3)]
    links, _ = brute.vector_links([(i, r[1], r[2]) for i, r in enumerate(rows)])
    assert dict(links) == {1: 1, 4: 1, 3: 1, 5: 1}
