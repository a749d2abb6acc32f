"""Byte-level BPE, target resampling and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import byte_codec, conversation_trie, queries, target_sample
from tests.llm.conftest import CLASHES, SF
from tests.oracle_check import compare, connect

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as file:
        return byte_codec.Codec(file.read(), PATTERN)


@pytest.mark.parametrize("chunk, overlap", [(byte_codec.CHUNK, byte_codec.OVERLAP), (300, 40), (16, 4)])
def test_bytes_agree_with_the_library(corpus, codec, chunk, overlap):
    found = byte_codec.encode(corpus.where("length(text) < 50000 OR text IS NULL"), RANKS, PATTERN, chunk=chunk, overlap=overlap)
    rows = byte_codec.decode(found, RANKS).collect()
    assert len(rows) == corpus.where("length(text) < 50000 OR text IS NULL").count()
    for r in rows:
        text = r.row.row.text or ""
        assert r.row.token_ids == codec.encoding.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert all(r.row.row[c] == f"{c}!" for c in CLASHES)


def test_long_texts_are_stitched(spark, codec):
    rng = random.Random(3)
    mixed = "".join(rng.choice(["don't ", "  ", "\n\n", "été", "12", "!!", " x", "日本"]) for _ in range(60_000))
    texts = [mixed, "z" * 150_000, mixed + " " * 9000 + mixed[::-1], mixed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = byte_codec.encode(docs, RANKS, PATTERN, chunk=8192, overlap=256).collect()
    assert len(rows) == 4
    for r in rows:
        ids = codec.encoding.encode_ordinary(r.row.text) if r.row.doc_id != 1 else byte_codec.merge_long(texts[1].encode(), codec.ranks)
        assert r.token_ids == ids


def test_long_pieces_and_other_characters(codec):
    rng = random.Random(4)
    for piece in ("x" * 3000, "日本語テ" * 400, "".join(rng.choice("abcde") for _ in range(2500))):
        assert byte_codec.merge_long(piece.encode(), codec.ranks) == codec.encoding.encode_ordinary(piece)
    # Characters that the two pattern libraries class differently.
    odd, pool = sorted(codec.stand_ins), "aé1 ½ ②\n\t '!.日's'll've \U0001f600"
    for _ in range(300):
        text = "".join(chr(rng.choice(odd)) if odd and rng.random() < 0.2 else rng.choice(pool) for _ in range(40))
        pieces = codec.split(text)
        assert codec.encode(pieces, np.array([len(pieces)]))[0].tolist() == codec.encoding.encode_ordinary(text)


def test_bytes_without_rows(spark, nothing):
    assert byte_codec.encode(nothing, RANKS, PATTERN).count() == 0
    ids = spark.createDataFrame([(None,), ([],)], "token_ids array<int>")
    assert [bytes(r.decoded) for r in byte_codec.decode(ids, RANKS).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_codec.decode(spark.createDataFrame([([1 << 20],)], "token_ids array<int>"), RANKS).collect()


def test_byte_query(spark, codec):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_bytes"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = codec.encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def features(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute_scores(rows, target):
    raw, wanted = Counter(), Counter()
    for _, text in rows:
        raw.update(map(bucket, features(text)[1]))
    for text in target:
        wanted.update(map(bucket, features(text)[1]))
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000))))
    found = []
    for doc_id, text in rows:
        words, all_features = features(text)
        weight = sum(gain(bucket(f)) for f in all_features) // len(all_features) if all_features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        found.append((doc_id, len(all_features), words, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return found


def test_running_crc():
    rng = random.Random(5)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 47, 48, 49, 500] + [rng.randint(1, 20) for _ in range(300)]]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    states = target_sample.crc_states(data, ends - [len(w) for w in words], ends, np.full(len(words), 0xFFFFFFFF, np.uint32))
    assert (~states).tolist() == [zlib.crc32(w) for w in words]
    again = target_sample.crc_states(data, ends - [len(w) for w in words], ends, states)
    assert (~again).tolist() == [zlib.crc32(w + w) for w in words]


def test_sample_on_edges(spark, corpus, texts, nothing):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = target_sample.resample(corpus, target).collect()
    want = brute_scores(texts, [r.text for r in target.collect()])
    assert Counter((r.row.doc_id, r.n_features, r.n_words, r.weight, r.score) for r in rows) == Counter(want)
    assert all(r.row[c] == f"{c}!" for r in rows for c in CLASHES)
    order = lambda w: (-w[4], w[0] is None, w[0] or 0)
    eligible = sorted((w for w in want if w[2] >= 20), key=order)
    drawn = sorted((r for r in rows if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 25 * len(eligible) // 100 + 1))
    assert [(r.score, r.row.doc_id) for r in drawn] == [(w[4], w[0]) for w in eligible[: len(drawn)]]
    again = target_sample.resample(corpus.repartition(5), target).collect()
    assert Counter((r.row.doc_id, r.row.text, r.rank) for r in rows) == Counter((r.row.doc_id, r.row.text, r.rank) for r in again)
    assert target_sample.resample(nothing, target).count() == 0
    assert target_sample.resample(corpus, nothing, percent=100).where("rank IS NOT NULL").count() == len(eligible)
    assert target_sample.resample(corpus, target, percent=0).where("rank IS NOT NULL").count() == 0


@pytest.mark.parametrize("same", [1, 3, 10**9])
def test_cutoff_is_exact(spark, same):
    draw = random.Random(same)
    rows = [(draw.randrange(same), 0, draw.randrange(same), draw.randrange(2), i) for i in range(500)]
    keys = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in target_sample.KEY)).repartition(7, "seq").cache()
    # Partitions of very different size, one of them empty.
    uneven = keys.unionByName(keys.limit(0))
    for rank in (1, 2, 250, 499, 500):
        assert target_sample.cutoff(uneven, rank) == sorted(rows)[rank - 1]


def test_sample_equals_sql(spark):
    assert compare(queries.QUERIES["op12_target"](spark, SF), connect(SF), queries.ORACLES["op12_target"]) == ""


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, mark, (role, text)))
    turns = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    below = defaultdict(lambda: [0, 0])
    for path, found in members.items():
        saved = (len(found) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            below[path[:d]][0] += path not in children
            below[path[:d]][1] += saved
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], *below[p], digest(ends.get(p, []))) for p, m in members.items()
    )


def some_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 1000, 10**12 + 1, 10**12]:
        rows += [(c, i, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é"])) for i in range(rng.choice([1, 2, 5, 12]))]
    rows += [(61, i, "user", "same" if i < 550 else "other") for i in range(600)] + [(62, i, "user", "same") for i in range(580)]
    rows += [(c, i, "user", "copy") for c in range(70, 90) for i in range(40)]
    rows += [(c, i, "user", "copy" if i < 35 else str(c % 3)) for c in range(100, 130) for i in range(37)]
    rows += [(3, None, "user", "no turn"), (3, None, None, "no turn"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group, edges", [(1 << 15, None), (60, None), (20, [0, 1, 4, 64])])
def test_trie_equals_brute_force(spark, monkeypatch, group, edges):
    monkeypatch.setattr(conversation_trie, "GROUP", group)
    monkeypatch.setattr(conversation_trie, "BIN", 200)
    monkeypatch.setattr(conversation_trie, "HOT_PARENT", 3)
    monkeypatch.setattr(conversation_trie, "BLOCK", 16)
    if edges:
        monkeypatch.setattr(conversation_trie, "EDGES", edges)
        monkeypatch.setattr(conversation_trie, "WIDE", 100)
    rows = some_conversations(group)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.select("*", *[F.lit(c).alias(c) for c in ("d", "mark", "size", "rep", "depth", "k1", "turns")])
    found = conversation_trie.prefix_trie(*conversation_trie.rebuilt(conversation_trie.numbered(table)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, found.collect())) == brute_trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    for rows in (table, table.limit(0)):
        assert conversation_trie.prefix_trie(*conversation_trie.rebuilt(conversation_trie.numbered(rows))).count() == 0


def test_conversations_without_turns(spark):
    """Their base is missing and all their turns are replaced."""
    alone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(alone, 0, "user", "x"), (alone, 1, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_trie.prefix_trie(*conversation_trie.rebuilt(conversation_trie.numbered(table))).collect()
    assert Counter(map(tuple, found)) == brute_trie(rows) and len(found) == 1


def test_trie_equals_sql(spark):
    assert compare(queries.QUERIES["op13_trie"](spark, SF), connect(SF), queries.ORACLES["op13_trie"]) == ""
