"""Language, quality, mixing, secrets and pieces against brute force on the edge corpus."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from math import erfc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cohortflow.llm import common, fair_mix, language_id, piece_codec, quality_trees, queries, secret_scan
from tests.llm.conftest import CLASHES, SF
from tests.oracle_check import compare, connect

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode())


def test_word_spans_and_hashes(texts):
    column = pa.array([t for _, t in texts])
    found = common.Words(column)
    lower = [bytes(w).lower() for _, t in texts for w in words(t)]
    assert found.counts.tolist() == [len(words(t)) for _, t in texts]
    assert [bytes(found.data[a:b]) for a, b in zip(found.starts, found.stops)] == lower
    by_hash = defaultdict(set)
    for h, w in zip(found.hashes().tolist(), lower):
        by_hash[h].add(w)
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len(set(lower))


def test_steps_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 100, "c"], "k": [1, 2, 3, 4, 5]})
    steps = list(common.text_steps([batch.slice(0, 2), batch.slice(2, 0), batch.slice(2)], limit=12))
    assert [k for s in steps for k in s.column("k").to_pylist()] == [1, 2, 3, 4, 5]
    assert max(s.num_rows for s in steps) >= 2


def test_suffix_automaton_reads_exactly_the_substrings():
    text = b"abracadabra"
    steps = language_id.suffix_automaton(text)
    parts = {text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)}

    def reads(word):
        at = 0
        for byte in word:
            if byte not in steps[at]:
                return False
            at = steps[at][byte]
        return True

    assert all(reads(p) for p in parts)
    assert not any(reads(w) for w in (b"bb", b"abraa", b"caa", b"dabrac", b"x"))


def test_phrases_are_longest_matches():
    model = language_id.Languages({"a": b"the cat sat", "b": b"der hund lief"})

    def phrases(reference, text):
        count, at = 0, 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in reference:
                size += 1
            at, count = at + size, count + 1
        return count

    cases = [b"the cat", b"hund sat", b"zzz", b"cat der cat", b"t"]
    data = np.frombuffer(b"".join(cases), np.uint8)
    found = model.phrases(data, np.array([len(c) for c in cases]))
    assert found.tolist() == [[phrases(b"the cat sat", c), phrases(b"der hund lief", c)] for c in cases]


def test_languages_on_edges(spark, corpus, nothing):
    model = language_id.learn(corpus)
    found = language_id.identify(corpus, model)
    rows = found.select("row.*", "lang_pred", found["score"].alias("share")).collect()
    assert len(rows) == corpus.count()
    for row in rows:
        assert all(row[c] == f"{c}!" for c in CLASHES)
        assert 0 <= row.share <= 1
        letters = any(ch.isalpha() for ch in row.text or "")
        assert (row.lang_pred == "und") == (not letters)
    again = {(r.row.text, r.lang_pred, r.score) for r in found.collect()}
    assert len(again) == len({t for t, _, _ in again})
    assert language_id.identify(nothing, model).count() == 0
    unlearned = language_id.identify(corpus, language_id.learn(nothing))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


@pytest.mark.parametrize("text", ["½ ②", "Ⅷ ² 3", "١٢٣", "— … !"])
def test_numbers_are_no_letters(spark, corpus, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs, language_id.learn(corpus)).collect()] == [("und", 0.0)]


def test_all_of_the_sample_is_used(spark):
    """Each of the texts drawn is in the reference."""
    draw = np.random.default_rng(21)
    rows = [("x", "".join(draw.choice(list("abcdefgh"), 400))) for _ in range(language_id.SAMPLE_ROWS)]
    docs = spark.createDataFrame([*rows, ("y", "other")], "lang string, text string")
    group, = language_id.learn(docs)
    assert group.price[0] >= np.log2(400 * language_id.SAMPLE_ROWS)
    data, sizes = language_id._letters([t for _, t in rows])
    assert (group.phrases(data, sizes)[:, 0] <= 3).all()


def test_many_languages_in_several_passes(spark, monkeypatch):
    draw = np.random.default_rng(20)
    words = {f"l{i:04d}": ["".join(draw.choice(list("abcdefghijklmnop"), 6)) for _ in range(12)] for i in range(2000)}
    prose = lambda name, n: " ".join(draw.choice(words[name], n))
    labelled = spark.createDataFrame([(name, prose(name, 30)) for name in words], "lang string, text string")
    monkeypatch.setattr(language_id, "TABLE_BYTES", 20 << 20)
    groups = language_id.learn(labelled)
    assert len(groups) > 2 and sum((g.names for g in groups), []) == sorted(words)
    asked = [name for name in list(words)[::100] for _ in range(2)]
    docs = spark.createDataFrame([(i, prose(name, 40)) for i, name in enumerate(asked)], "doc_id long, text string")
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, groups).collect()}
    assert [found[i][0] for i in range(len(asked))] == asked
    monkeypatch.setattr(language_id, "TABLE_BYTES", 1 << 40)
    whole = language_id.learn(labelled)
    assert len(whole) == 1
    assert found == {r.row.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, whole).collect()}


@pytest.mark.parametrize("shards", [64, 4096])
def test_batches_are_dealt_to_all_shards(shards):
    numbers = [(partition << 24) + k for partition in range(shards) for k in range(5)]
    used = {common.dealt(n, shards) for n in numbers}
    assert len(used) > 0.95 * shards and min(used) >= 0 and max(used) < shards


def test_language_accuracy(spark):
    found = queries.QUERIES["op1_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows} == {2}
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98


def test_flat_trees_equal_walked_trees():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = quality_trees.grow(x, y, rounds=20)

    def walk(row):
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            at = 0
            while 2 * at + 1 < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > threshold[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert np.mean((forest.score(x) > 0.5) == y) > 0.97


def test_statistics_of_known_texts():
    stats = quality_trees.statistics(pa.array(["One two.\nOne TWO 3!\n", None, "", "é|"]))
    named = dict(zip(quality_trees.STATISTICS, stats[0]))
    assert np.isclose(named["words"], np.log1p(5)) and np.isclose(named["lines"], np.log1p(2))
    assert np.isclose(named["distinct_words"], 4 / 5) and np.isclose(named["lines_ended"], 1)
    assert np.isclose(named["upper_words"], 1 / 5) and np.isclose(named["digit_words"], 1 / 5)
    assert np.isfinite(stats).all() and (stats[1] == stats[2]).all()


def test_quality_on_edges(spark, corpus, nothing):
    labels = spark.createDataFrame(
        [(i, 0 if i % 5 == 0 else 1) for i in range(200)] + [(3, 0), (None, 1), (4, None), (5, 7), (99_999, 1)], "doc_id long, quality int"
    )
    forest = quality_trees.learn(corpus, labels, F.lit(True))
    found = quality_trees.score(corpus, forest).collect()
    assert len(found) == corpus.count() and all(0 <= r.score <= 1 for r in found)
    assert len({(r.row.text, r.score) for r in found}) == len({r.row.text for r in found})
    assert all(r.row.score == "score!" for r in found)
    assert quality_trees.score(nothing, forest).count() == 0
    one_class = quality_trees.learn(corpus, labels.where("quality = 1"), F.lit(True))
    assert all(r.score > 0.99 for r in quality_trees.score(corpus, one_class).collect())
    unlearned = quality_trees.learn(corpus, labels, F.lit(False))
    assert {r.score for r in quality_trees.score(corpus, unlearned).collect()} == {0.5}


def test_quality_accuracy(spark):
    found = queries.QUERIES["op5_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.97


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    full = set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        shares = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / shares for s in names}
        more = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix_on_edges(corpus, texts, nothing):
    rows = fair_mix.fair_mix(fair_mix.queue_rows(corpus)).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(words(t))) for i, t in texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    target = brute_targets(sizes)
    largest = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and np.isclose(r.target, target[r.source])
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
        largest[r.source] = max(largest[r.source], r.size)
    # Equal rows finish at the same time, so half of two documents can be missing.
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] for s in sizes)
    again = fair_mix.fair_mix(fair_mix.queue_rows(corpus.repartition(7))).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    mixed = Counter((r.doc_id, r.text) for r in fair_mix.mixed_rows(corpus).collect())
    copies = {(r.doc_id, r.digest): r.copies for r in rows}
    for (doc_id, text), n in Counter(texts).items():
        assert mixed[doc_id, text] == n * copies[doc_id, hashlib.md5((text or "").encode()).hexdigest()]
    assert fair_mix.fair_mix(fair_mix.queue_rows(nothing)).count() == 0
    assert fair_mix.mixed_rows(nothing).columns == nothing.columns


@pytest.mark.parametrize("sizes", [[("a", 10), ("b", 1), ("c", 1)], [("a", 0), (None, 5)], [("a", 1), ("b", 1000), ("c", 3), ("d", 3)], [("a", 0)]])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(sizes, "source string, size long")
    found = {r.source: r.target for r in fair_mix.source_targets(frame).collect()}
    want = brute_targets(dict(sizes))
    assert found.keys() == want.keys() and all(np.isclose(found[s], want[s]) for s in want)


def test_mix_equals_sql(spark):
    assert compare(queries.QUERIES["op9_mix"](spark, SF), connect(SF), queries.ORACLES["op9_mix"]) == ""


def brute_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets_on_edges(corpus, nothing):
    rows = secret_scan.scan(corpus).collect()
    assert len(rows) == corpus.count()
    for r in rows:
        assert [tuple(s) for s in r.base] == brute_spans(r.row.text or "")
        assert all(s.end - s.start >= secret_scan.MIN_TOKEN for s in r.extra)
        assert not [1 for s in r.extra for b in r.base if b.start < s.end and s.start < b.end]
    assert secret_scan.scan(nothing).count() == 0
    clean = {(r.doc_id, r.text) for r in secret_scan.redacted(corpus).collect()}
    for r in rows:
        marked = r.row.text
        for s in reversed(sorted(r.base + r.extra)):
            marked = marked[: s.start] + "\0" * (s.end - s.start) + marked[s.end :]
        marked = re.sub("\0+", "[secret]", marked) if marked and "\0" in marked else marked
        assert any(i == r.row.doc_id and (t or "").replace("[secret][secret]", "[secret]") == (marked or "") for i, t in clean)


def test_random_runs_are_told_from_words(spark):
    draw = np.random.default_rng(5)
    alphabet = np.array(list("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    keys = ["".join(draw.choice(alphabet, 32)) for _ in range(200)]
    keys = [k if any(c.isdigit() for c in k) else k + "7" for k in keys]
    patterned = [f"section-{i}-of-the-annual-report-of-the-committee" for i in range(60)]
    prose = [" ".join("".join(draw.choice(["tion", "the", "en", "an", "er", "ou"], 6)) for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(keys + patterned + prose)], "doc_id long, text string")
    found = {r.row.doc_id: len(r.extra) for r in secret_scan.scan(docs).collect()}
    assert np.mean([found[i] == 1 for i in range(200)]) > 0.9
    assert sum(found[i] for i in range(200, 560)) <= 3


@pytest.mark.parametrize("before", ["signature=", "https://host/get?sig=", "store/objects/v2/", "build_artifact_", "run-id-"])
@pytest.mark.parametrize("alphabet, size", [("0123456789ABCDEF", 32), ("0123456789abcdef", 28), ("0123456789abcdefghijklmnopqrstuvwxyz", 40)])
def test_secrets_behind_names_and_paths(spark, before, alphabet, size):
    draw = np.random.default_rng(6)
    keys = ["".join(draw.choice(list(alphabet), size)) for _ in range(100)]
    prose = [" ".join("".join(draw.choice(["tion", "the", "en", "an", "er", "ou"], 6)) for _ in range(30)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([f"see {before}{k} here" for k in keys] + prose)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert np.mean([k not in left[i] for i, k in enumerate(keys)]) > 0.8
    assert [left[100 + i] for i in range(100)] == prose


def random_keys(seed, count, size, alphabet="0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    """With a digit each, as a run of letters alone is a word."""
    draw = np.random.default_rng(seed)
    return ["".join(draw.choice(list(alphabet), size - 1)) + str(draw.integers(10)) for _ in range(count)]


def test_a_small_table_is_scanned_as_well(spark):
    """No words of the table can serve as decoys."""
    keys = random_keys(8, 50, 40)
    docs = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    assert sum(left[i] == "see [secret] here" for i in range(50)) >= 45
    alone = secret_scan.redacted(docs.where("doc_id < 3")).collect()
    assert sum(k not in r.text for r, k in zip(sorted(alone), keys)) >= 2


def test_running_values(spark):
    draw = np.random.default_rng(9)
    rows = [(draw.integers(0, 50, n).tolist(),) for n in (0, 1, 2, 3, 10, 97, 1000)]
    found = spark.createDataFrame(rows, "v array<bigint>").select(
        "v", secret_scan.running(F.col("v"), lambda a, v: a + v).alias("sums"), secret_scan.running(F.col("v"), lambda a, v: F.greatest(a, v)).alias("tops")
    )
    for r in found.collect():
        assert r.sums == [sum(r.v[:i]) for i in range(len(r.v))]
        assert r.tops == [max(r.v[:i], default=0) for i in range(len(r.v))]


def test_untouched_and_widest(spark):
    draw = random.Random(10)
    span = lambda kind: (lambda a: (a, kind, a + draw.randint(1, 12), "x"))(draw.randint(0, 200))
    rows = [([(*span(3), "t") for _ in range(n)], sorted(span(0) for _ in range(m))) for n, m in ((0, 3), (5, 0), (30, 10), (60, 4))]
    frame = spark.createDataFrame(rows, f"a array<{secret_scan.SPAN[:-1]},token:string>>, b array<{secret_scan.SPAN}>")
    for r in frame.select("a", "b", secret_scan._untouched(F.col("a"), F.col("b")).alias("free")).collect():
        want = [s for s in r.a if not any(b.start < s.end and s.start < b.end for b in r.b)]
        assert sorted(map(tuple, r.free)) == sorted(map(tuple, want))
    nested = [(0, 3, 50, "x"), (0, 3, 10, "x"), (10, 3, 50, "x"), (12, 3, 20, "x"), (60, 3, 80, "x"), (60, 3, 80, "x"), (90, 3, 95, "x")]
    draw.shuffle(nested)
    found = spark.createDataFrame([(nested,)], f"a array<{secret_scan.SPAN}>").select(secret_scan._widest(F.col("a")).alias("w")).first().w
    assert [(s.start, s.end) for s in found] == [(0, 50), (60, 80), (90, 95)]


def test_very_long_texts_are_scanned_in_time(spark):
    texts = [
        random_keys(11, 1, 1 << 20)[0],
        " ".join(random_keys(12, 50_000, 40)),
        " ".join(random_keys(13, 50_000, 32, "0123456789abcdef")),
        " ".join(f"token={a} {b}" for a, b in zip(random_keys(14, 20_000, 20), random_keys(15, 20_000, 44))),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    started = time.perf_counter()
    rows = {r.doc_id: r for r in secret_scan.redacted(docs).collect()}
    assert time.perf_counter() - started < 150
    assert rows[0].text == "[secret]"
    assert rows[1].text.count("[secret]") > 45_000 and rows[2].text == " ".join(["[secret]"] * 50_000)
    assert rows[3].text.count("[secret]") > 38_000


def test_secret_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bars = secret_scan.acceptance(docs)
    joined = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    rows = queries.QUERIES["op10_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r.spans == joined(sorted(base + brute_battery(texts[r.doc_id], base, bars)))


def brute_battery(text, base, bars):
    """Random runs and parts, by the same statistics in numpy."""
    spans = {(m.start(), m.end()) for p in (secret_scan.CANDIDATE, *secret_scan.PARTS) for m in re.finditer(p, text)}
    spans = {s for s in spans if not any(a < s[1] and s[0] < b for a, _, b, _ in base)}
    passing = set()
    for a, b in spans:
        token = text[a:b]
        alphabet = next((alpha for p, alpha in secret_scan.ENCODINGS if re.match(p, token)), secret_scan.WIDEST)
        band = sum(len(token) >= least for least in secret_scan.BANDS) - 1
        if noise(token, len(alphabet), [alphabet.index(c) + 1.0 for c in token]) >= bars[band]:
            passing.add((a, b))
    return [(a, 3, b, "random") for a, b in passing if not any((c, d) != (a, b) and c <= a and b <= d for c, d in passing)]


def noise(token, m, codes):
    c, n = np.array(codes), float(len(token))
    squares = sum(v * v for v in Counter(token).values())
    chi = (squares * m / n - n - (m - 1)) / np.sqrt(2 * (m - 1) * (1 - 1 / n))
    high, above = float((c > m / 2).sum()), c > m / 2
    turns = 1 + (above[1:] != above[:-1]).sum()
    product = 2 * high * (n - high)
    runs = (turns - 1 - product / n) / np.sqrt(max(1, product * (product - n) / (n * n * (n - 1))))
    around = c - c.mean()
    spread = (around**2).sum()
    serial = np.sqrt(n) * (around[1:] * around[:-1]).sum() / spread if spread else np.sqrt(n)
    q = chi * chi + runs * runs + serial * serial
    return erfc(np.sqrt(q / 2)) + np.sqrt(2 * q / np.pi) * np.exp(-q / 2)


def test_parts_of_runs():
    cut = [re.findall(p, "name=0123456789abcdefABCDEF==") for p in (secret_scan.CANDIDATE, *secret_scan.PARTS)]
    assert cut == [["name=0123456789abcdefABCDEF=="]] + [["0123456789abcdefABCDEF=="]] * 3
    cut = [re.findall(p, "a/b-c_0123456789abcdefABCDEF") for p in (secret_scan.CANDIDATE, *secret_scan.PARTS)]
    assert [c[0] for c in cut] == ["a/b-c_0123456789abcdefABCDEF"] * 2 + ["b-c_0123456789abcdefABCDEF", "0123456789abcdefABCDEF"]


def test_pieces_agree_with_the_library(spark, corpus, nothing):
    peer = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL_PATH)
    found = piece_codec.encode(corpus)
    for r in found.collect():
        assert r.token_ids == peer.encode(r.row.text or "") and r.n_tokens == len(r.token_ids)
        assert r.parity and r.round_trip and r.row._text == "_text!"
    plain = found.select(F.col("row.text").alias("original"), "token_ids")
    for r in piece_codec.decode(plain).collect():
        assert r.decoded == (r.row.original or "").replace("▁", " ")
    assert piece_codec.encode(nothing).count() == 0
    assert [r.decoded for r in piece_codec.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).collect()] == [""]


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2]) + bytes([len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3]) + bytes([value])
    return out


def test_unigram_models_are_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(p, s, 1) for p, s in [("▁", -3.0), ("▁the", -1.0), ("▁c", -4.0), ("at", -2.0), ("a", -5.0), ("t", -5.0), ("c", -5.0), ("▁▁", -6.0)]]
    trainer = bytes([3 << 3, 1]) + b"\x98\x02\x01"  # unigram, byte fallback (field 35)
    data = b"".join(b"\x0a" + bytes([len(m)]) + m for m in (_message((1, p.encode()), (2, s), (3, k)) for p, s, k in pieces))
    normalizer = _message((1, b"identity"), (3, 1), (4, 0), (5, 1))
    data += b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normalizer)]) + normalizer
    codec = piece_codec.Codec(data)
    assert codec.model.kind == piece_codec.UNIGRAM and codec.model.byte_fallback
    texts = ["the cat", "cat  that", "", " the", "xyz é", "<s>the"]
    ids, offsets, same = codec.encode(texts)
    assert same.all()
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [codec.peer.encode(t) for t in texts]
    assert codec.decode(ids, offsets) == texts
