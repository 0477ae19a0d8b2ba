"""Exact, line, SimHash and embedding deduplication against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.llm import embed_dedup, exact_dedup, line_dedup, simhash
from queuelens.llm.queries import QUERIES, table
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, kept string, `_digest` int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], SCHEMA)


ODD = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (None, "a b"), (None, None), (5, "x" * 300_000), (6, "x" * 300_000), (7, " a b")]


def exact_expected(rows):
    out = []
    for i, t in rows:
        same = [d for d, u in rows if (u or "") == (t or "")]
        keep = max((d for d in same if d is not None), default=None)
        out.append((i, keep, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [256, 4])
def test_exact(spark, width):
    # With one hexadecimal digit for a digest, most texts share theirs with others and must still be told apart.
    digest = exact_dedup.sha256 if width == 256 else lambda c: F.substring(exact_dedup.sha256(c), 1, 1)
    rows = ODD + [(100 + i, f"text {i % 40}") for i in range(200)]
    got = exact_dedup.dedup_exact(rows_of(spark, rows), digest=digest).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    expected = [x[:3] for x in exact_expected(rows)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted(expected, key=key)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    stay = exact_dedup.drop_copies(rows_of(spark, rows), digest=digest)
    assert stay.columns == ["doc_id", "text", "kept", "_digest"]
    assert sorted((r.text or "") for r in stay.collect()) == sorted({t or "" for _, t in rows})


def test_exact_normal_form(spark):
    got = exact_dedup.dedup_exact(rows_of(spark, [(1, "A"), (2, "a")]), normal=F.lower).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(1, 2), (2, 2)}


def test_empty_tables(spark):
    none = rows_of(spark, [])
    assert exact_dedup.dedup_exact(none).count() == exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_one_each(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embed_dedup.near_duplicate_vectors(vectors).count() == 0


def test_fingerprint_matches_plain(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()] + [None, "", "one", "A b\tc\x0bd É ", "x " * 70_000]
    assert [simhash.fingerprint(t) for t in texts] == [brute.fingerprint(t) for t in texts]


def test_simhash_components(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    prints, parts = brute.simhash_components(docs)
    # Small tiles, so that many of one population count meet.
    found = simhash.near_duplicates(table(spark, sf, "documents"), tile=3).collect()
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == parts
    whole = QUERIES["op10_simhash_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in whole} == {d: (f"{prints[d]:016x}", parts[d]) for d, _ in docs}


def test_simhash_links_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 30)
    values = {0, *map(int, seeds)}
    for s in seeds:  # chains of near values
        for _ in range(20):
            s = int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False))
            values.add(s)
    values = sorted(values)
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    got = simhash.links(prints, 4, tile=16).collect()
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert all(r.a > r.b for r in got)
    assert brute.roots(values, [(r.a, r.b) for r in got]) == brute.roots(values, pairs)
    from queuelens.llm.common import components

    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    expected = brute.roots(values, pairs)
    linked = {x for p in pairs for x in p}
    assert {r.node: r.component for r in components(frame, "test").collect()} == {v: expected[v] for v in linked}


def test_simhash_keeps_one(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (4, base.replace("w7 ", "W7 ")), (5, base + " tail"), (None, base), (7, "other " * 9), (8, None), (3, ""), (7, "other " * 9)]
    stay = simhash.keep_one_each(rows_of(spark, rows))
    assert stay.columns == ["doc_id", "text", "kept", "_digest"]
    assert sorted(r.doc_id for r in stay.collect()) == [3, 4, 7]


def test_simhash_keeps_components_of_one_smallest_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(400)) for c in "xyz")
    for rows, stay in (
        ([(None, one), (None, two)], [one, two]),
        ([(4, one), (4, two)], [one, two]),
        ([(None, one), (None, two), (None, two + " tail"), (4, three), (4, three), (None, three)], [one, two, three]),
    ):
        got = [(r.doc_id, r.text) for r in simhash.keep_one_each(rows_of(spark, rows)).collect()]
        assert sorted(t.removesuffix(" tail") for _, t in got) == stay
        assert all((i, t) in rows and (t != three or i == 4) for i, t in got)


def near_vectors(rng, n, dim=24):
    centres = rng.standard_normal((n // 8, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.25])
        out.append([float(x) for x in np.float32(v)])
    return out


@pytest.mark.parametrize("chunk", [256, 16])
def test_vectors(spark, chunk):
    rng = np.random.default_rng(3)
    rows = [(i, v, int(rng.integers(2))) for i, v in enumerate(near_vectors(rng, 600))]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]  # copies
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] * 24, [None] * 24, [1.0]]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, rows[0][1], None), (3001, [1.0, 2.0], 0), (3002, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicate_vectors(frame, chunk=chunk).collect()}
    links, parts = brute.vector_links(rows)
    assert set(got) == {r[0] for r in rows}
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(links.values())
    assert np.mean([got[i].component_id == parts[i] for i in got]) > 0.97
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert got[3001].component_id == got[3002].component_id == 3001


def test_vector_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, sf, "embeddings").collect()]
    links, parts = brute.vector_links(rows)
    got = {r.vec_id: r for r in QUERIES["op6_embedding_dedup"](spark, sf).collect()}
    assert all(got[i].n_links <= links[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(links.values())
    assert sum(got[i].component_id == parts[i] for i in got) >= 0.98 * len(got)


def test_blocks_follow_the_rows():
    d = 0.2
    shapes = [embed_dedup.block_shape(n, d) for n in (10, 10**4, 10**6, 10**8)]
    assert shapes == sorted(shapes)
    for cuts, tables in shapes:
        together = 0.886**cuts
        assert 1 - (1 - together) ** tables > 0.99


def test_lines(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def changed(line):
        at, how = rng.randrange(len(line)), rng.randrange(4)
        if how == 0:
            return line[:at] + rng.choice("abcd ") + line[at + 1 :]
        if how == 1:
            return line[:at] + line[at + 1 :]
        return line[:at] + rng.choice("abcd") + line[at:] if how == 2 else line

    docs = []
    for i in range(80):
        lines = [rng.choice([*base, ""]) for _ in range(rng.randint(0, 6))]
        docs.append((i, "\n".join(changed(x) if x and rng.random() < 0.6 else x for x in lines)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (None, base[0] + "\n  " + base[1] + " "), (503, "é" * 50 + "\n" + "é" * 49 + "\n" + "x" * 50_000)]
    got = line_dedup.dedup_lines(rows_of(spark, docs), min_near=12).collect()
    expected = brute.kept_lines(docs, 12)
    assert {r.doc_id: r.text for r in got} == expected
    assert len(got) == len(docs)
    plain = line_dedup.dedup_lines(rows_of(spark, docs), bound=0).collect()
    assert {r.doc_id: r.text for r in plain} == brute.kept_lines(docs, 10**9)


def test_line_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    expected = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in brute.kept_lines(docs).items()}
    assert {r.doc_id: r.text_sha256 for r in QUERIES["op8_line_dedup"](spark, sf).collect()} == expected


def test_repeated_rows_share_their_lines(spark):
    got = line_dedup.dedup_lines(rows_of(spark, [(1, "same line that is long enough"), (1, "same line that is long enough"), (2, "same line that is long enougH")]))
    assert sorted((r.doc_id, r.n_dropped) for r in got.collect()) == [(1, 0), (1, 0), (2, 1)]


def variants(line):
    """The hashes of a line's deletions, in order, and of the line."""
    return [np.concatenate(c) for c in list(zip(*line_dedup.variant_blocks(line)))[:2]]


def test_variants_are_the_hashes_of_shorter_lines(monkeypatch):
    line = "".join(random.Random(2).choice("abé\U0001f600 ") for _ in range(90))
    short = [variants(line[:i] + line[i + 1 :]) for i in range(len(line))]
    for block in (line_dedup.BLOCK, 64, 7, 89, 90, 91):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        line_dedup.powers.cache_clear()
        a, b = variants(line)
        assert len(a) == len(line) + 1
        assert [(x, y) for x, y in zip(a[:-1], b[:-1])] == [(s[0][-1], s[1][-1]) for s in short]
    monkeypatch.undo()
    line_dedup.powers.cache_clear()


def test_variants_of_long_lines_leave_in_blocks():
    import pyarrow as pa

    lines = ["ab" * 500_000, "short line", "", "z" * 70_000]
    batch = pa.RecordBatch.from_pydict({"id": [7, 8, 9, 10], "line": lines})
    found = list(line_dedup.with_variants([batch]))
    assert max(b.num_rows for b in found) < 2 * line_dedup.BLOCK + 100
    rows = pa.Table.from_batches(found).to_pandas()
    for number, line in zip((7, 8, 9, 10), lines):
        own = rows[rows.id == number]
        assert list(own.spot) == [*range(len(line)), -1]
        # The same letter taken out anywhere in a run gives one variant.
    assert rows[(rows.id == 10) & (rows.spot >= 0)].v1.nunique() == 1


def test_all_edits_share_a_half_and_a_variant():
    """Every line within one edit of another one is found, whatever the place of the edit."""
    line = "abcabcaabbccabcabcabcaab"
    edits = {line[:i] + c + line[i + k :] for i in range(len(line) + 1) for c in ("", "a", "z") for k in (0, 1)} - {line}
    own = variants(line)
    mine = {(int(a), int(b), i) for i, (a, b) in enumerate(zip(*own))}
    whole = (int(own[0][-1]), int(own[1][-1]))
    for other in edits:
        keys = variants(other)
        theirs = {(int(a), int(b), i) for i, (a, b) in enumerate(zip(*keys))}
        if len(other) == len(line):
            assert mine & theirs
        elif len(other) > len(line):
            assert whole in {x[:2] for x in theirs}
        else:
            assert (int(keys[0][-1]), int(keys[1][-1])) in {x[:2] for x in mine}
