"""Joins, components, suffix index and language model against brute force on the edge corpus."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import class_lm, packing, queries, shingle_join, suffix_index
from cohortflow.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def grams(text, n):
    w = tokens(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def roots(count, pairs):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(count)]


@pytest.mark.parametrize("kind", [np.uint8, np.uint32, np.int64, np.uint64, np.float64])
def test_packing_round_trip(kind):
    for size in (0, 1, 1000):
        values = (np.random.default_rng(size).random(size) * 200).astype(kind)
        assert (packing.unpack(packing.pack(values), kind) == values).all()
        if kind != np.float64:
            assert (packing.unpack_sorted(packing.pack_sorted(np.sort(values)), kind) == np.sort(values)).all()


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed):
    draw = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 120, size=(70, 2))] + [(200 + k, 201 + k) for k in range(12)] + [(300, 300 + k) for k in range(1, 50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    root = roots(400, pairs)
    smallest = {}
    for x in range(400):
        smallest.setdefault(root[x], x)
    ends = {x for p in pairs if p[0] != p[1] for x in p}
    assert found == {x: smallest[root[x]] for x in ends}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingles_are_word_sequences(texts):
    for n in (1, 4, 5):
        found = shingle_join.shingles(pa.array([t for _, t in texts]), n)
        assert np.bincount(found.owner, minlength=len(texts)).tolist() == [len(grams(t, n)) for _, t in texts]
        by_hash = defaultdict(set)
        for k, (_, t) in enumerate(texts):
            mine = found.values[found.owner == k]
            for g in grams(t, n):
                by_hash[g].update([k])
            assert len(set(mine.tolist())) == len(mine)
        shared = Counter(found.values.tolist())
        assert sorted(shared.values()) == sorted(len(v) for v in by_hash.values())


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_near_duplicates_equal_brute_force(corpus, texts, nothing, n, percent):
    sets = [grams(t, n) for _, t in texts]
    pairs = []
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                pairs.append((a, b))
    root = roots(len(sets), pairs)
    smallest = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        if i is not None:
            smallest[root[k]].append(i)
    want = Counter((i, len(sets[k]), min(smallest[root[k]], default=None)) for k, (i, _) in enumerate(texts))
    found = Counter(map(tuple, shingle_join.near_duplicates(corpus, n, percent).collect()))
    assert found == want
    kept = Counter((r.doc_id, r.text) for r in shingle_join.distinct_documents(corpus, n, percent).collect())
    groups = defaultdict(set)
    for k, (i, t) in enumerate(texts):
        groups[root[k] if sets[k] else ("empty", k)].add((i, t))
    assert sum(kept.values()) == len(groups)
    for members in groups.values():
        assert kept.keys() & members
    assert shingle_join.near_duplicates(nothing, n, percent).count() == 0
    assert shingle_join.distinct_documents(nothing, n, percent).columns == nothing.columns


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Links that only chains of copies make, hubs that link with few, and n-grams that are frequent within a batch."""
    monkeypatch.setattr(shingle_join, "LOCALLY_HOT", 3)
    draw = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(60):
        words = list(base)
        for at in range(0, k, 1):
            words[(at * 7) % 120] = f"x{at}"
        docs.append((k, " ".join(words)))
    docs += [(100 + k, " ".join(draw.choice(base, 30))) for k in range(30)]
    sets = {i: grams(t, 3) for i, t in docs}
    ids = [i for i, _ in docs]
    pairs = [
        (a, b) for a in range(len(ids)) for b in range(a)
        if 100 * len(sets[ids[a]] & sets[ids[b]]) >= 80 * len(sets[ids[a]] | sets[ids[b]])
    ]
    root = roots(len(ids), pairs)
    smallest = {}
    for k, i in enumerate(ids):
        smallest[root[k]] = min(smallest.get(root[k], i), i)
    found = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 80).collect()}
    assert found == {i: smallest[root[k]] for k, i in enumerate(ids)}


def test_anchors_are_content_defined(texts):
    """Equal 200-byte strings have the same anchor hash, wherever they stand."""
    column = pa.array([t for _, t in texts])
    runs = suffix_index.Runs(column)
    seen = {}
    total = 0
    for first, last, anchor, owner in zip(runs.first, runs.last, runs.anchor, runs.owner):
        assert runs.offsets[owner] <= first <= last <= runs.offsets[owner + 1] - 200
        total += last - first + 1
        for start in range(first, last + 1, 13):
            string = runs.data[start : start + 200].tobytes()
            assert seen.setdefault(string, anchor) == anchor
    assert total == sum(max(0, len((t or "").encode()) - 199) for _, t in texts)


def test_levels_merge_geometrically():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 99, size=4000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    index = suffix_index.LogIndex(100)
    hits, number = set(), 0
    for low in range(0, 3900, 300):
        part = data[low : min(low + 399, 4000)]
        starts = np.arange(len(part) - 99)
        hits |= set(index.add(part, starts, number + starts).tolist())
        number += len(starts)
    assert [rank for rank, *_ in index.levels] == sorted({rank for rank, *_ in index.levels}, reverse=True)
    assert sum(2**rank for rank, *_ in index.levels) == 13
    strings = [data[k : k + 100].tobytes() for k in range(3901)]
    times = Counter(strings)
    assert hits == {k for k, s in enumerate(strings) if times[s] > 1}


@pytest.mark.parametrize("batch_bytes, suffixes", [(4 << 20, 1 << 16), (20_000, 500)])
def test_repeats_equal_brute_force(corpus, texts, nothing, monkeypatch, batch_bytes, suffixes):
    monkeypatch.setattr(suffix_index, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(suffix_index, "BATCH_SUFFIXES", suffixes)
    raw = [(t or "").encode() for _, t in texts]
    times = Counter(hash(x[k : k + 200]) for x in raw for k in range(len(x) - 199))
    want = Counter()
    for (i, _), x in zip(texts, raw):
        stays = np.ones(len(x), bool)
        for k in range(len(x) - 199):
            if times[hash(x[k : k + 200])] > 1:
                stays[k : k + 200] = False
        edges = np.diff(np.concatenate([[0], (~stays).astype(int), [0]]))
        spans = tuple(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        want[i, len(x), spans, np.frombuffer(x, np.uint8)[stays].tobytes()] += 1
    found = suffix_index.without_repeats(corpus).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in found) == want
    assert suffix_index.without_repeats(nothing).count() == 0


def test_no_shard_holds_a_crowded_anchor(spark, monkeypatch):
    """One passage in 400 texts: its strings are dealt out by fingerprint, and the cuts are those of brute force."""
    monkeypatch.setattr(suffix_index, "CROWDED", 50)
    draw = np.random.default_rng(4)
    letters = lambda n: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passage = letters(500)
    rows = [(i, letters(250) + passage + letters(250)) for i in range(400)] + [(400, letters(900)), (401, passage), (402, passage)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    starts = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    for r in suffix_index.without_repeats(frame).collect():
        text = dict(rows)[r.doc_id]
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 199):
            if starts[text[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert bytes(r.kept).decode() == "".join(c for c, g in zip(text, gone) if not g)
    named = frame.select("text", F.unhex(F.md5("text")).alias("digest"))
    anchors = suffix_index.repeated_anchors(named, 3, 200)
    sent = suffix_index.sent_stretches(named.join(anchors, "digest"), 16, 200)
    told = Counter()
    for r in sent.select("shard", "kind", "bytes").collect():
        told[r.shard] += len(packing.unpack(bytes(r.bytes), np.uint64)) if r.kind == suffix_index.PRINTS else 0
    assert len(told) == 16 and max(told.values()) <= 2 * sum(told.values()) / 16


def test_crowded_or_not_the_cuts_are_the_same(corpus, monkeypatch):
    found = []
    for bound in (1 << 30, 0):
        monkeypatch.setattr(suffix_index, "CROWDED", bound)
        found.append(Counter((r.doc_id, str(r.spans), bytes(r.kept)) for r in suffix_index.without_repeats(corpus).collect()))
    assert found[0] == found[1]


def test_repeats_query(spark, sf_dir):
    rows = queries.QUERIES["op7_repeats"](spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.n_bytes == len(docs[r.doc_id])
        if not r.n_removed:
            assert r.n_spans == 0 and r.kept_sha256 == hashlib.sha256(docs[r.doc_id]).hexdigest()


def test_exchange_finds_the_classes():
    draw = np.random.default_rng(4)
    kinds = np.array([0] + [1 + k % 3 for k in range(30)])
    pairs = np.zeros((31, 31))
    follows = {0: 1, 1: 2, 2: 3, 3: 1}
    for a in range(31):
        for b in range(1, 31):
            if kinds[b] == follows[kinds[a]]:
                pairs[a, b] = draw.integers(5, 20)
    found = class_lm.exchange_classes(pairs, classes=4)
    assert found[0] == 0
    assert len({(k, c) for k, c in zip(kinds, found)}) == 4


def test_exchange_never_lowers_the_likelihood():
    draw = np.random.default_rng(5)
    pairs = draw.poisson(1.5, size=(40, 40)).astype(float)

    def likelihood(classes):
        member = np.zeros((40, 6))
        member[np.arange(40), classes] = 1
        f = lambda n: (n * np.log(np.maximum(n, 1))).sum()
        table = member.T @ pairs @ member
        return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))

    steps = [likelihood(class_lm.exchange_classes(pairs, 6, sweeps)) for sweeps in range(4)]
    assert all(b >= a - 1e-6 for a, b in zip(steps, steps[1:])) and steps[-1] > steps[0]


@pytest.mark.parametrize("frequent", [8192, 20])
def test_scores_on_edges(corpus, texts, nothing, monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    monkeypatch.setattr(class_lm, "BATCH_BYTES", 50_000)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scores, model = class_lm.score_documents(corpus, held_out)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for i, t in texts:
        if not out(i):
            counts.update([*tokens(t), None])
    total = sum(counts.values())
    assert model.train_tokens == total
    price = math.log10(total + 0.5 * (len(counts) + 1))
    want = Counter()
    for i, t in texts:
        w = [*tokens(t), None]
        want[i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10(counts[x] + 0.5) - price for x in w), 4)] += 1
    rows = scores.collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    # The model's prices form a distribution: over all words of a class, with one place for unknown words.
    assert np.allclose((10**model.step).sum(axis=1), 1)
    empty, _ = class_lm.score_documents(nothing, held_out)
    assert empty.count() == 0
    unlearned, _ = class_lm.score_documents(corpus, F.lit(True))
    assert all(abs(r.base_score) < 1e-9 and r.n_known == 0 for r in unlearned.collect())


def test_classes_beat_the_base(spark):
    rows = queries.QUERIES["op8_classes"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.9


def planted_corpus(spark, words_per_class=400, texts=1500):
    """Words of four classes that follow each other in turn; far more words than types of histories, and endings tell nothing."""
    draw = np.random.default_rng(17)
    words = [[f"w{draw.integers(1 << 40):x}-{k % 7}" for k in range(words_per_class)] for _ in range(4)]
    rows = []
    for i in range(texts):
        start = int(draw.integers(4))
        # Ten words of each class make up most of the text: those are the types of histories.
        drawn = [int(draw.integers(10 if draw.random() < 0.6 else words_per_class)) for _ in range(40)]
        rows.append((i, " ".join(words[(start + k) % 4][n] for k, n in enumerate(drawn))))
    return spark.createDataFrame(rows, "doc_id long, text string"), words


def test_every_word_of_the_vocabulary_is_clustered(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "WORD_TYPES", 40)
    monkeypatch.setattr(class_lm, "TYPES", 2 + 40 + class_lm.ENDING_TYPES)
    monkeypatch.setattr(class_lm, "FREQUENT", 64)
    monkeypatch.setattr(class_lm, "BATCH_BYTES", 100_000)
    docs, words = planted_corpus(spark)
    traces = []
    original = class_lm.cluster_vocabulary
    monkeypatch.setattr(class_lm, "cluster_vocabulary", lambda found: traces.append(original(found)) or traces[-1])
    vocabulary = class_lm.count_words(docs, 5, "text")
    model, named = class_lm.learn(docs, vocabulary, 5)
    kinds = {}
    for row in named.collect():
        kinds |= zip(packing.unpack_sorted(bytes(row["keys"]), np.uint64).tolist(), packing.unpack(bytes(row["classes"]), np.uint8).tolist())
    assert len(kinds) == 1600 and 0 not in kinds.values()
    # The likelihood grows until it stands still, and each class of words is told from the others.
    table, _, trace = traces[0]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(trace, trace[1:])) and len(trace) >= 2
    column = lambda group: class_lm.word_keys(class_lm.Words(pa.array(group)))
    of_class = [Counter(kinds[k] for k in column(group).tolist()) for group in words]
    shared = sum(sum((a & b).values()) for i, a in enumerate(of_class) for b in of_class[:i])
    assert shared <= 0.05 * 1600
    # No worse than exchange clustering of the types alone, measured on the same table of histories by classes.
    gain = lambda t: (t * np.log(np.maximum(t, 1))).sum() - (t.sum(axis=0) * np.log(np.maximum(t.sum(axis=0), 1))).sum()
    histories = model.histories
    found = class_lm.contexts(docs, vocabulary, spark.sparkContext.broadcast((model.types, histories)), 5, "text")
    before, _ = class_lm._summed_table(found, lambda w, b, t, k: (k.astype(np.int64), 0.0))
    assert gain(table) > gain(before)
    scores, _ = class_lm.score_documents(docs, F.lit(False))
    assert scores.where("score > base_score").count() == scores.count()
