"""Curve search and cap filters against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import cap_dedup, curve_search, queries
from tests.llm.test_duplicates import roots


@pytest.fixture(scope="module")
def rows():
    """(vec_id, embedding, label): clusters, copies, near copies, scaled copies, and all that takes no part."""
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(6, 16))
    vectors = [centres[k % 6] + 0.4 * draw.normal(size=16) for k in range(300)]
    vectors += [vectors[5]] * 40 + [2 * vectors[9], -vectors[9]]
    vectors += [vectors[7] + 0.02 * draw.normal(size=16) for _ in range(30)]
    found = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vectors)]
    return found + [
        (400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, None), (403, [float("inf")] + [1.0] * 15, 1),
        (404, [None] + [1.0] * 15, 1), (405, [1.0, 2.0], 1), (406, [], 1), (None, [1.0] * 16, 1), found[3], found[20],
    ]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("!") for c in ("v", "id", "rep", "block")})


def usable(rows):
    good = [(i, v) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and None not in v]
    return [(i, np.array(v)) for i, v in good if np.isfinite(v).all() and np.any(np.array(v) != 0)]


def test_neighbouring_keys_are_neighbouring_cells():
    cells = np.array([[a, b] for a in range(16) for b in range(16)])
    keys = curve_search.hilbert_keys(cells, 4)
    assert sorted(keys.tolist()) == list(range(256))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    cells = np.array(np.meshgrid(*[range(4)] * 3)).reshape(3, -1).T
    walk = cells[np.argsort(curve_search.hilbert_keys(cells, 2))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_search_equals_brute_force_on_edges(frame, rows):
    good = list({(i, tuple(v)): (i, v) for i, v in usable(rows)}.values())
    found = defaultdict(list)
    for r in curve_search.nearest(frame, F.col("vec_id") % 20 == 0, "vec_id", "embedding").orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    queries_ = {i: v for i, v in good if i % 20 == 0}
    assert found.keys() == queries_.keys()
    hits = total = 0
    for i, v in queries_.items():
        best = sorted(((-float(v @ w), j) for j, w in good if j != i))[:20]
        want = [j for _, j in best]
        assert [s for _, s in found[i]] == sorted((s for _, s in found[i]), reverse=True)
        assert len(found[i]) == 20 and i not in [j for j, _ in found[i]]
        hits += len(set(want) & {j for j, _ in found[i]})
        total += 20
    assert hits / total >= 0.97


def test_copies_do_not_crowd_a_search(spark):
    """The query is one of 100 equal vectors: its nearest are the smallest ids of the others, then come other vectors."""
    draw = np.random.default_rng(11)
    vectors = draw.normal(size=(200, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, vectors[0 if i % 2 else i].tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = curve_search.nearest(frame, F.col("vec_id") == 101, "vec_id", "embedding").orderBy("rank").collect()
    assert [r.vec_id for r in found] == [0, *range(1, 39, 2)]


def test_recall_without_structure(spark):
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(6000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in curve_search.nearest(frame, F.col("vec_id") % 20 == 0, "vec_id", "embedding").collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for i in range(0, 6000, 20):
        scores = vectors @ vectors[i]
        scores[i] = -np.inf
        recall.append(len(set(np.argsort(-scores)[:20].tolist()) & found[i]) / 20)
    assert np.mean(recall) >= 0.9


def test_search_of_few_or_no_rows(frame):
    few = frame.where("vec_id in (0, 1, 2, 400)")
    found = curve_search.nearest(few, F.col("vec_id") % 20 == 0, "vec_id", "embedding").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, found[0].vec_id), (0, 2, found[1].vec_id)]
    assert curve_search.nearest(frame.limit(0), F.col("vec_id") % 20 == 0, "vec_id", "embedding").count() == 0


def test_code_lists_exactly_the_exceeding_filters():
    draw = np.random.default_rng(1)
    unit = draw.normal(size=(50, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    code = cap_dedup.ProductCode(12, 400, unit)
    parts = code._scores(unit)
    whole = (parts[0][:, :, None] + parts[1][:, None, :]).reshape(50, -1)
    for row, found in zip(whole, code.decode(unit)):
        exceeding = np.flatnonzero(row >= code.bar)
        if len(exceeding) >= cap_dedup.PASSED_LEAST:
            assert found.tolist() == exceeding.tolist()
        else:
            assert len(found) >= cap_dedup.PASSED_LEAST and set(exceeding) <= set(found)


@pytest.mark.parametrize("block", [2048, 16])
def test_links_equal_brute_force_on_edges(frame, rows, monkeypatch, block):
    monkeypatch.setattr(cap_dedup, "BLOCK", block)
    good = usable(rows)
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    root = roots(len(good), list(zip(*np.nonzero(links))))
    smallest = {}
    for k, (i, _) in enumerate(good):
        smallest[root[k]] = min(smallest.get(root[k], i), i)
    want = Counter((i, int(links[k].sum()), smallest[root[k]], smallest[root[k]] == i) for k, (i, _) in enumerate(good))
    want.update((i, 0, i, True) for i in range(400, 407))
    want[None, 0, None, None] += 1
    found = Counter(map(tuple, cap_dedup.near_duplicates(frame, "vec_id", "embedding").collect()))
    assert found == want
    assert cap_dedup.near_duplicates(frame.limit(0), "vec_id", "embedding").count() == 0


def test_links_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.vec_id: (r.n_links, r.component_id) for r in queries.QUERIES["op4_caps"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    unit = np.array([r.embedding for r in rows], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert [found[r.vec_id][0] for r in rows] == links.tolist()


@pytest.mark.parametrize("vectors", [2_000, 1_000_000])
@pytest.mark.parametrize("decay", [0.0, 0.5])
def test_pairs_at_the_limit_meet_at_any_size(vectors, decay):
    draw = np.random.default_rng(77)
    scale = np.arange(1, 65) ** -decay
    sample, unit, step = (cap_dedup._units(draw.normal(size=(n, 64)) * scale) for n in (256, 500, 500))
    step = cap_dedup._units(step - (step * unit).sum(axis=1, keepdims=True) * unit)
    moved = 0.9501 * unit + np.sqrt(1 - 0.9501**2) * step
    code = cap_dedup.fitted_code(64, vectors, sample, 0.95)
    assert min(map(len, code.decode(unit))) >= code.least
    assert cap_dedup.missed(code, unit, (np.arange(500), moved)) <= 6


@pytest.mark.parametrize("length", [2, 5])
def test_links_in_few_dimensions(spark, length):
    draw = np.random.default_rng(length)
    unit = cap_dedup._units(draw.normal(size=(600, length)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    found = {r.id: r.n_links for r in cap_dedup.near_duplicates(frame, "vec_id", "embedding").collect()}
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert sum(found.values()) >= 0.995 * want.sum() and all(found[i] <= n for i, n in enumerate(want.tolist()))


def test_links_of_the_sample_are_links(spark):
    draw = np.random.default_rng(3)
    unit = cap_dedup._units(np.repeat(draw.normal(size=(20, 8)), 50, axis=0) + 0.1 * draw.normal(size=(1000, 8)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "rep long, v array<double>").repartition(5)
    first, moved = cap_dedup._sample_links(frame, np.arange(0, 1000, 50), unit[::50], 0.95)
    want = np.minimum((unit[::50] @ unit.T >= 0.95).sum(axis=1) - 1, cap_dedup.SAMPLE_LINKS)
    assert np.bincount(first, minlength=20).tolist() == want.tolist()
    assert ((moved * unit[::50][first]).sum(axis=1) >= 0.95 - 1e-12).all() and len(np.unique(moved, axis=0)) <= 1000


def test_queries_of_another_length_than_the_rows(spark):
    """Short vectors at ids that ask do not set the length of all."""
    draw = np.random.default_rng(31)
    rows = [(i, draw.normal(size=16).tolist()) for i in range(100) if i % 20 or i in (20, 40, 60, 80)]
    rows += [(1000 + 20 * i, [1.0, float(i)]) for i in range(6)]
    found = curve_search.nearest(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") % 20 == 0, "vec_id", "v")
    assert {r.query_id for r in found.collect()} == {20, 40, 60, 80}


def test_an_id_on_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (20, [0.9, 0.1])]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = {r.vec_id: r.score for r in curve_search.nearest(frame, F.col("vec_id") == 20, "vec_id", "v").collect()}
    assert found == pytest.approx({1: 0.9, 2: 0.1})
    linked = cap_dedup.near_duplicates(frame, "vec_id", "v").collect()
    # The first vector is linked with that of 20, the second one is shared by ids 1 and 2.
    assert sorted((r.id, r.n_links, r.component_id) for r in linked) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (20, 1, 1)]
