from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cohortflow.operators import profiles
from cohortflow.operators.features import fit_features, with_engagement
from cohortflow.schemas import CORRUPT, FEATURES, RAW_INPUTS, TARGET, USER
from cohortflow.sources import capture, registry, requests, reviews, selector, snapshots, synthetic, tables, zones

HEADER = ["marketplace", "customer_id", "star_rating", "helpful_votes", "total_votes", "review_body", "verified_purchase"]


def review_file(path, lines):
    with gzip.open(path, "wt", encoding="utf-8") as file:
        file.write("\n".join("\t".join(line) for line in [HEADER, *lines]) + "\n")
    return str(path)


GOOD_LINES = [["US", f"c{i}", "5", "1", "2", f"body {i}", "Y"] for i in range(20)]


def test_review_fields_are_taken_literally(spark, tmp_path):
    path = review_file(tmp_path / "r.tsv.gz", [
        ["US", "a", "5", "1", "2", 'say "hi" \\ there', "Y"],
        ["US", "b", "4", "0", "0", '"open quote', "N"],
        ["US", "c", "3"],
    ])
    rows = {r["customer_id"]: r for r in reviews.read_reviews(spark, path).collect()}
    assert rows["a"]["review_body"] == 'say "hi" \\ there'
    assert rows["b"]["review_body"] == '"open quote'
    assert rows["c"]["star_rating"] == "3" and rows["c"]["review_body"] is None and rows["c"]["verified_purchase"] is None
    assert reviews.overlong_rows(spark, path).count() == 0


def test_file_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        lines = [["US", f"c{part}{i:03d}", "5", "1", "2", "x", "Y"] for i in range(50)]
        review_file(folder / f"part-{part}.tsv.gz", lines)
    df = reviews.read_reviews(spark, str(folder))
    expected = [f"c{part}{i:03d}" for part in range(3) for i in range(50)]
    assert [r["customer_id"] for r in df.orderBy(*reviews.FILE_ORDER).collect()] == expected
    seen = profiles.first_seen_customers(df, reviews.FILE_ORDER).orderBy("_first_seen")
    assert [r["customer_id"] for r in seen.collect()] == expected


def test_files_with_swapped_columns_are_refused(spark, tmp_path):
    folder = tmp_path / "swapped"
    folder.mkdir()
    review_file(folder / "a.tsv.gz", GOOD_LINES)
    swapped = [HEADER[0], HEADER[2], HEADER[1], *HEADER[3:]]
    with gzip.open(folder / "b.tsv.gz", "wt") as file:
        file.write("\t".join(swapped) + "\n" + "\t".join(["US", "5", "c1", "1", "2", "x", "Y"]) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        reviews.read_reviews(spark, str(folder)).collect()


def test_a_bad_line_costs_one_row(spark, tmp_path):
    lines = [["US", f"c{i}", "5", "1", "2", f"body {i}", "Y"] for i in range(12_000)]
    lines[700] = [*lines[700], "extra"]
    lines[900] = [*lines[900], "", " "]  # blanks at the end do not make a row longer
    path = review_file(tmp_path / "r.tsv.gz", lines)
    rejects = str(tmp_path / "rejects")
    users = selector.load_users(spark, "reviews", path, rejects=rejects)
    assert users.count() == 11_999 and users.where("user_id = 'amz_user_c700'").count() == 0
    assert [r["line"] for r in spark.read.parquet(rejects).collect()] == ["\t".join(lines[700])]


def test_missing_review_column(spark, tmp_path):
    path = tmp_path / "bad.tsv"
    path.write_text("customer_id\tstar_rating\na\t5\n")
    with pytest.raises(reviews.MalformedFile, match="review_body"):
        reviews.read_reviews(spark, str(path))


@pytest.mark.parametrize("kind", ["reviews", "shop-reviews"])
def test_selector_reads_reviews(spark, tmp_path, kind):
    path = review_file(tmp_path / "r.tsv.gz", GOOD_LINES)
    count = lambda users: {r["data_source"]: r["count"] for r in users.groupBy("data_source").count().collect()}
    assert count(selector.load_users(spark, kind, path)) == {"reviews": 20}
    assert count(selector.load_users(spark, kind, path, fill=True)) == {"reviews": 20, "synthetic": 4980}


def test_selector_raises_and_falls_back_only_when_asked(spark, tmp_path):
    for kind, path in [("reviews", str(tmp_path / "absent.tsv")), ("taxi", None), ("reviews", None)]:
        users = selector.load_users(spark, kind, path, n=30, on_error="fallback")
        assert [tuple(r) for r in users.groupBy("data_source").count().collect()] == [("synthetic", 30)]
        with pytest.raises(Exception):  # noqa: B017 - any error will do, as long as it is raised
            selector.load_users(spark, kind, path).count()
    assert selector.load_users(spark, "synthetic", n=7).count() == 7


def test_raw_zone_keeps_runs_and_reads_the_newest(spark, tmp_path):
    zone = str(tmp_path / "zone")
    older, newer = synthetic.synthetic_cohort(spark, 10), synthetic.synthetic_cohort(spark, 25, seed=1)
    assert snapshots.write_raw(older, zone, "20240101_000000")["rows"] == 10
    report = snapshots.write_raw(newer, zone, "20240102_000000")
    assert report == {"location": f"{zone}/experiment-data/ingest_ts=20240102_000000", "rows": 25}
    read = snapshots.latest_run(spark, zone, USER)
    assert read.schema == USER
    assert read.count() == 25
    assert read.drop("created_at").exceptAll(newer.drop("created_at").withColumn(
        "previous_experiments", F.nullif("previous_experiments", F.lit(""))
    )).count() == 0


def test_latest_file_by_name(spark, tmp_path):
    schema = USER
    for stamp, user in [("20240101_000000", "old"), ("20240301_000000", "new"), ("20240201_000000", "middle")]:
        text = ",".join(schema.names) + f"\n{user},30,M,US,1,2.0,3,4,5.0,0.5,,0.1,2024-01-01T00:00:00\n"
        (tmp_path / f"user-bucketing-data-{stamp}.csv").write_text(text)
    (tmp_path / "zzz.txt").write_text("not a csv")
    rows = snapshots.latest_file(spark, str(tmp_path), schema).collect()
    assert [r["user_id"] for r in rows] == ["new"]
    assert rows[0]["previous_experiments"] is None


def test_no_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="no CSV files"):
        snapshots.latest_file(spark, str(tmp_path))


REQUEST = {
    "age": 35, "session_count": 20, "avg_session_duration": 450.0, "page_views": 35, "purchase_history": 5,
    "total_spent": 250.0, "engagement_score": 0.75, "historical_conversion_rate": 0.4, "gender": "female", "location": "US",
}


def test_json_object_and_array(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(REQUEST, indent=1))
    (tmp_path / "two.json").write_text(json.dumps([REQUEST, REQUEST | {"age": 50}], indent=1))
    rows = requests.accepted(requests.read_requests(spark, str(tmp_path), multi_line=True)).collect()
    assert sorted(r["age"] for r in rows) == [35.0, 35.0, 50.0]


def test_json_lines_keep_bad_text(spark, tmp_path):
    lines = [REQUEST, REQUEST | {"age": "old"}, REQUEST | {"page_views": "many"}]
    text = "\n".join(json.dumps(line) for line in lines) + '\n{"age": 3\n' + json.dumps(REQUEST | {"total_spent": float("nan")})
    (tmp_path / "lines.json").write_text(text)
    parsed = requests.read_requests(spark, str(tmp_path / "lines.json"))
    # Few selected columns must not hide a bad value in another one.
    assert requests.accepted(parsed).select("age").count() == 2
    assert requests.quarantined(parsed).select(CORRUPT).count() == 3
    assert requests.accepted(parsed).where(F.col("total_spent").isNull()).count() == 1
    with pytest.raises(ValueError, match="only application"):
        requests.read_requests(spark, str(tmp_path), content_type="text/csv")


def test_bodies_of_every_form(spark, tmp_path):
    bad = [REQUEST | {"gender": 5}, REQUEST | {"location": ["US"]}]
    lines = [
        json.dumps([REQUEST | {"age": 1}, REQUEST | {"age": 2}]), "", "   ", json.dumps(REQUEST | {"age": 3}), "[]",
        json.dumps([REQUEST | {"age": 4}, bad[0]]), json.dumps(bad[1]), "[1, 2", "7", json.dumps(REQUEST | {"gender": None, "age": 5}),
    ]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    parsed = requests.read_requests(spark, str(tmp_path / "lines.json"))
    assert sorted(r["age"] for r in requests.accepted(parsed).collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]
    kept = sorted(r[CORRUPT] for r in requests.quarantined(parsed).collect())
    assert [json.loads(k) if k.startswith("{") else k for k in kept] == ["7", "[1, 2", "[]", *sorted(bad, key=json.dumps)]


def test_elements_that_are_no_objects_and_words_for_numbers(spark, tmp_path):
    words = [REQUEST | {"total_spent": "Infinity"}, REQUEST | {"age": "NaN"}, REQUEST | {"age": "-INF"}, REQUEST | {"age": "12"}]
    lines = [json.dumps([REQUEST | {"age": 1}, None]), json.dumps([[REQUEST], 5, "text", REQUEST | {"age": 2}]), *map(json.dumps, words), '{"age": Infinity}', '{"age": -Infinity, "gender": "M"}', "null", "true"]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    parsed = requests.read_requests(spark, str(tmp_path / "lines.json"))
    assert sorted(r["age"] for r in requests.accepted(parsed).collect()) == [1.0, 2.0]
    kept = [r[CORRUPT] for r in requests.quarantined(parsed).collect()]
    assert sorted(k for k in kept if not k.startswith("{")) == sorted(["null", json.dumps([REQUEST], separators=(",", ":")), "5", "text", "null", "true"])
    assert sum(k.startswith("{") for k in kept) == 6
    assert all(v is None for r in requests.quarantined(parsed).collect() for c, v in r.asDict().items() if c != CORRUPT and r[CORRUPT] == "null")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_split_zone(spark, sf_dir, tmp_path, fmt):
    users = with_engagement(tables.user_rows(spark, sf_dir)).withColumns(
        {"y": (F.col("c_custkey") % 2).cast("int"), "split": F.when(F.col("c_custkey") % 3 == 0, "test").otherwise("train")}
    )
    state = fit_features(users)
    transformed = state.transform(users)
    path = str(tmp_path / "zone")
    zones.write_splits(transformed, path, "y", fmt)
    raw = zones.read_split(spark, path, "test", "raw", fmt)
    expected = users.where("split = 'test'").select(*RAW_INPUTS, F.col("y").alias(TARGET))
    assert raw.columns == [*RAW_INPUTS, TARGET]
    assert raw.exceptAll(expected).count() == 0 and raw.count() == expected.count()
    scaled = zones.read_split(spark, path, "train", "scaled", fmt)
    wanted = transformed.where("split = 'train'").select("features_scaled.*", F.col("y").alias(TARGET))
    assert scaled.columns == [*FEATURES, TARGET]
    assert scaled.exceptAll(wanted).count() == 0
    with pytest.raises(ValueError, match="unknown split"):
        zones.read_split(spark, path, "other")


def test_registry_gate(spark, tmp_path):
    schema = "model_id string, path string, metrics struct<auc:double>, approve_model boolean"
    good = spark.createDataFrame([("good", "p", (0.9,), True)], schema)
    bad = spark.createDataFrame([("bad", "p", (0.6,), False)], schema)
    table, rejects = str(tmp_path / "registry"), str(tmp_path / "rejects")
    registry.gate_and_register(good, table)
    with pytest.raises(registry.ModelRejected, match="bad"):
        registry.gate_and_register(bad, table)
    for _ in range(2):
        # A model that is registered again replaces its own row, and no other.
        registry.gate_and_register(good.unionByName(bad), table, rejects, status="PendingManualApproval")
    registry.gate_and_register(good.withColumn("model_id", F.lit("0012")), table)
    schema = "model_id string, path string, metrics struct<auc:double>, status string, registered_at timestamp"
    found = registry.read_rows(spark, table, schema).collect()
    assert sorted((r["model_id"], r["status"], r["metrics"]["auc"]) for r in found) == [("0012", "Approved", 0.9), ("good", "PendingManualApproval", 0.9)]
    assert [r["model_id"] for r in registry.read_rows(spark, rejects, "model_id string").collect()] == ["bad"]


def test_registry_has_one_writer(spark, tmp_path):
    good = spark.createDataFrame([("good", "p", (0.9,), True)], "model_id string, path string, metrics struct<auc:double>, approve_model boolean")
    table = str(tmp_path / "registry")
    with registry.single_writer(spark, table):
        with pytest.raises(registry.RegistryBusy):
            registry.gate_and_register(good, table)
    registry.gate_and_register(good, table)
    assert registry.read_rows(spark, table, "model_id string").count() == 1
    assert registry.read_rows(spark, str(tmp_path / "none"), "model_id string").count() == 0


def test_approval_flag(spark):
    texts = ['{"approve_model": true}', '{"approve_model": false}', "{}", "no json"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(registry.approval_flag(F.col("t"))).collect()] == [True, False, False, False]


def test_capture_share(spark):
    df = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("user_id"))
    everything = df.where(capture.captured(F.col("user_id"))).count()
    quarter = df.where(capture.captured(F.col("user_id"), 0.25))
    assert everything == 5000
    assert quarter.count() / 5000 == pytest.approx(0.25, abs=0.03)
    assert quarter.exceptAll(df.repartition(9).where(capture.captured(F.col("user_id"), 0.25))).count() == 0
