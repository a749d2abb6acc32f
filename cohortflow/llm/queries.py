"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import byte_codec, cap_dedup, class_lm, conversation_trie, curve_search, fair_mix, language_id, piece_codec, quality_trees, secret_scan, shingle_join, suffix_index, target_sample
from cohortflow.llm.common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents by source weights takes of each."""
    rows = fair_mix.queue_rows(table(spark, sf_dir, "documents"))
    return fair_mix.fair_mix(rows).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op9_mix"] = r"""
WITH queue AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(md5(cast(doc_id AS varchar)), '') AS place, md5(coalesce(text, '')) AS digest
  FROM documents),
sums AS (SELECT source, sum(size) AS source_size FROM queue GROUP BY source),
weighed AS (
  SELECT source, cast(source_size AS bigint) AS source_size, [5.0e0, 2.0e0, 1.0e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sums),
filled AS (
  SELECT *, cast(3 * source_size AS double) AS most, cast(3 * source_size AS double) / weight AS fill FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER early, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER early, 0)) AS level
  FROM filled WINDOW early AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, weight * (SELECT first(level ORDER BY fill, source NULLS FIRST) FROM levels WHERE level <= fill)) AS target FROM levels),
reached AS (
  SELECT doc_id, size, source_size, target,
         sum(size) OVER (PARTITION BY q.source ORDER BY place, size, digest) AS reached
  FROM queue q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN cast(size AS bigint) * (
         cast(cast(2 * reached - size AS double) <= 2 * target AS bigint)
         + cast(cast(2 * (reached + source_size) - size AS double) <= 2 * target AS bigint)
         + cast(cast(2 * (reached + 2 * source_size) - size AS double) <= 2 * target AS bigint)) ELSE 0 END AS taken
FROM reached"""


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts per pattern, a digest of the pattern spans, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secret_scan.digest_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.digest_text(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled rows."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    languages = language_id.learn(docs.where(~held_out).select("text", "lang"))
    named = language_id.identify(docs, languages, keep=["doc_id"])
    return named.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", held_out)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from two thirds of the labelled rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    forest = quality_trees.learn(docs.select("doc_id", "text"), labels, ~held_out)
    scored = quality_trees.score(docs, forest, keep=["doc_id"])
    return scored.select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether they decode to the text, and whether sentencepiece agrees."""
    found = piece_codec.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "round_trip", "parity", "token_ids")


@query
def op3_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows to every twentieth embedding."""
    return curve_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding")


@query
def op4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return cap_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query
def op2_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles agree to 85 %."""
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-based log10 probabilities of all documents, learned from four fifths of them."""
    held_out = F.coalesce(id_remainder("doc_id", 5) == 1, F.lit(False))
    scores, model = class_lm.score_documents(table(spark, sf_dir, "documents"), held_out)
    return scores.withColumns({"held_out": held_out, "train_tokens": F.lit(model.train_tokens).cast("long")})


@query
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings leave of every document."""
    found = suffix_index.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes that they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_codec.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = byte_codec.decode(found.select(F.col("row.doc_id").alias("doc_id"), "token_ids"), ranks)
    ids = F.col("row.token_ids")
    return decoded.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(byte_codec.ids_text(ids), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn towards the words and word pairs of the benchmark texts."""
    drawn = target_sample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: crc32 in SQL: the table of the polynomial, and the sum of a column ``f`` by its bytes.
_CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list(v ORDER BY n) AS steps
  FROM (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(n)))"""
_CRC_SUM = """4294967295 - list_reduce([4294967295] || list_transform(range(1, 2 * strlen(f), 2), lambda i: cast('0x' || substr(hex(encode(f)), i, 2) AS bigint)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))"""

ORACLES["op12_target"] = rf"""
WITH {_CRC_TABLE},
texts AS (
  SELECT row_number() OVER () AS seq, 'd' AS kind, doc_id, text FROM documents
  UNION ALL SELECT row_number() OVER (), 'b', item_id, text FROM benchmark),
worded AS (
  SELECT seq, kind, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM texts),
features AS (
  SELECT seq, kind, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f FROM worded),
counted AS (SELECT seq, kind, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (SELECT f, ({_CRC_SUM}) % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc),
placed AS (SELECT seq, kind, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT cast(coalesce(sum(n) FILTER (kind = 'd'), 0) AS double) AS raw, cast(coalesce(sum(n) FILTER (kind = 'b'), 0) AS double) AS target FROM placed),
gains AS (
  SELECT bucket, cast(floor(1000 * ln(((t + 1) * (target_raw + 10000)) / ((s + 1) * (target + 10000)))) AS bigint) AS gain
  FROM (SELECT bucket, cast(coalesce(sum(n) FILTER (kind = 'd'), 0) AS double) AS s, cast(coalesce(sum(n) FILTER (kind = 'b'), 0) AS double) AS t FROM placed GROUP BY bucket),
       (SELECT raw AS target_raw, target FROM totals)),
sums AS (SELECT seq, sum(n * gain) AS gain FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY seq),
scored AS (
  SELECT w.seq, doc_id, len(words) AS n_words, greatest(2 * len(words) - 1, 0) AS n_features,
    CASE WHEN len(words) = 0 THEN 0 ELSE cast(floor(cast(gain AS double) / (2 * len(words) - 1)) AS bigint) END AS weight,
    cast('0x' || substr(sha256('7:' || doc_id), 1, 8) AS bigint) AS h
  FROM worded w LEFT JOIN sums USING (seq) WHERE kind = 'd'),
noisy AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS bigint) AS score FROM scored),
drawn AS (
  SELECT seq, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 25 * count(*) OVER () // 100 AS wanted FROM noisy WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= wanted THEN rank END AS rank FROM noisy LEFT JOIN drawn USING (seq)"""


@query
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    turns = conversation_trie.numbered(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(turns))


ORACLES["op13_trie"] = rf"""
WITH {_CRC_TABLE},
marked AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos FROM marked),
members AS (
  SELECT conv_id, ({_CRC_SUM}) % 9 AS h FROM (SELECT DISTINCT conv_id, cast(conv_id AS varchar) AS f FROM turns), crc),
rebuilt AS (
  SELECT m.conv_id, t.pos AS d, mark, size FROM members m JOIN turns t ON t.conv_id = m.conv_id - m.conv_id % 5 AND t.pos <= h
  UNION ALL
  SELECT m.conv_id, pos - h + least(h, (SELECT count(*) FROM turns b WHERE b.conv_id = m.conv_id - m.conv_id % 5)), mark, size
  FROM members m JOIN turns t ON t.conv_id = m.conv_id AND t.pos > h),
paths AS (
  SELECT conv_id, d, size, string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM members),
nodes AS (SELECT path, d, min(conv_id) AS rep, count(*) AS n, min(size) AS size FROM paths GROUP BY path, d),
children AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, d - 1 AS d, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL),
ends AS (
  SELECT path, d, sha256(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE d = last GROUP BY path, d),
below AS (
  SELECT a.path, a.d, sum(CASE WHEN c.path IS NULL THEN 1 ELSE 0 END) AS leaves, sum((b.n - 1) * b.size) AS saved
  FROM nodes b JOIN paths a ON a.conv_id = b.rep AND a.d <= b.d LEFT JOIN children c ON c.path = b.path AND c.d = b.d
  GROUP BY a.path, a.d)
SELECT n.rep AS conv_id, n.d AS depth, p.rep AS parent_conv_id, n.n AS n_convs, coalesce(c.children, 0) AS n_children,
  cast(leaves AS bigint) AS n_leaves, cast(saved AS bigint) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN below USING (path, d) LEFT JOIN children c USING (path, d) LEFT JOIN ends USING (path, d)
  LEFT JOIN nodes p ON p.path = substr(n.path, 1, 32 * (n.d - 1)) AND p.d = n.d - 1"""
