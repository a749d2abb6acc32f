"""SQL equivalents of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

from cohortflow.functions.draws import poisson_cdf

# Written down apart from the code under test.
# The names of the features.
_FEATURE_NAMES = [
    "age", "session_count", "avg_session_duration", "page_views", "purchase_history", "total_spent", "engagement_score",
    "historical_conversion_rate", "spend_per_purchase", "session_efficiency", "gender_encoded", "location_encoded",
    "age_group_encoded", "spending_tier_encoded",
]

GENDER_VALUES = ["male", "female", "other", "M", "F", "O"]

USERS = """
o AS (SELECT o_custkey AS k, count(*) AS n, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS amt
      FROM orders GROUP BY o_custkey),
e AS (SELECT user_id AS k, count(*) AS n, cast(sum(cast(value AS decimal(18,2))) AS double) AS dur,
             sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views
      FROM events GROUP BY user_id),
users_v AS (
  SELECT c_custkey,
    concat('user_', lpad(cast(c_custkey AS varchar), 6, '0')) AS user_id,
    CASE WHEN c_custkey % 101 = 0 THEN 0 WHEN c_custkey % 103 = 0 THEN 120 ELSE cast(18 + c_custkey % 63 AS int) END AS age,
    CASE WHEN c_custkey % 25 < 12 THEN 'M' WHEN c_custkey % 25 < 24 THEN 'F' ELSE 'Other' END AS gender,
    CASE c_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' WHEN 2 THEN 'CA' WHEN 3 THEN 'AU' WHEN 4 THEN 'DE' ELSE 'FR' END AS location,
    CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE cast(coalesce(e.n, c_custkey % 23) AS bigint) END AS session_count,
    cast(coalesce(e.dur, 30.0 * (c_custkey % 37)) AS double) AS avg_session_duration,
    cast(coalesce(e.views, c_custkey % 41) AS bigint) AS page_views,
    cast(CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE coalesce(o.n, 0) END AS bigint) AS purchase_history,
    CASE WHEN c_custkey % 17 = 0 THEN 0.0e0 ELSE coalesce(o.amt, 0.0e0) / 10000.0e0 END AS total_spent,
    (c_custkey % 11) / 10.0e0 AS historical_conversion_rate
  FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey)"""

ENGAGED = (
    USERS
    + """,
raw_v AS (SELECT *, 0.3e0 * ln(1 + session_count) + 0.2e0 * ln(1 + avg_session_duration / 60.0e0)
                    + 0.3e0 * ln(1 + page_views) + 0.2e0 * ln(1 + total_spent) AS raw FROM users_v),
ext_v AS (SELECT min(raw) AS low, max(raw) AS high FROM raw_v),
eng_v AS (SELECT raw_v.*, (raw - low) / nullif(high - low, 0) AS engagement_score FROM raw_v, ext_v)"""
)

LABELLED = (
    ENGAGED
    + """,
cut_v AS (SELECT quantile_cont(engagement_score, 0.7) AS qe, quantile_cont(total_spent, 0.6) AS qs FROM eng_v),
lab_v AS (SELECT eng_v.*, cast(coalesce(engagement_score > qe AND total_spent > qs, false) AS int) AS high_value_user
          FROM eng_v, cut_v)"""
)

_TIERS = """
  CASE WHEN {age} <= 0 THEN NULL WHEN {age} <= 25 THEN 'young' WHEN {age} <= 35 THEN 'adult'
       WHEN {age} <= 50 THEN 'middle_aged' WHEN {age} <= 100 THEN 'senior' END AS age_group,
  CASE WHEN {spent} <= -1 THEN NULL WHEN {spent} <= 0 THEN 'none' WHEN {spent} <= 50 THEN 'low'
       WHEN {spent} <= 200 THEN 'medium' WHEN {spent} IS NOT NULL THEN 'high' END AS spending_tier""".format(
    age="age", spent="total_spent"
)

_RATIOS = """
  CASE WHEN coalesce(purchase_history > 0, false) THEN total_spent / purchase_history ELSE 0 END AS spend_per_purchase,
  page_views / (CASE WHEN session_count IS NULL THEN NULL ELSE greatest(session_count, 1) END) AS session_efficiency"""


def derived(source: str, name: str = "der_v") -> str:
    return f"{name} AS (SELECT *, {_RATIOS}, {_TIERS} FROM {source})"


def vocabulary(source: str, name: str = "voc_v") -> str:
    pairs = " UNION ".join(
        f"SELECT '{n}' AS feature, coalesce({n}, 'nan') AS value FROM {source}"
        for n in ["gender", "location", "age_group", "spending_tier"]
    )
    return (
        f"{name} AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS idx "
        f"FROM ({pairs}) p)"
    )


def encoded(source: str, vocab: str = "voc_v", name: str = "enc_v") -> str:
    columns = ", ".join(
        f"coalesce((SELECT idx FROM {vocab} v WHERE v.feature = '{n}' AND v.value = coalesce(s.{n}, 'nan')), 0) AS {n}_encoded"
        for n in ["gender", "location", "age_group", "spending_tier"]
    )
    return f"{name} AS (SELECT s.*, {columns} FROM {source} s)"


def scaler(source: str, name: str = "scl_v") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, avg(coalesce({n}, 0)::double) AS mean, "
        f"CASE WHEN stddev_pop(coalesce({n}, 0)::double) = 0 THEN 1 ELSE stddev_pop(coalesce({n}, 0)::double) END AS std FROM {source}"
        for n in _FEATURE_NAMES
    )
    return f"{name} AS ({rows})"


SPLIT = (
    LABELLED
    + """,
hash_v AS (SELECT *, ('0x' || substr(md5('42:' || user_id), 1, 15))::bigint AS h FROM lab_v),
cnt_v AS (SELECT high_value_user AS l, count(*) AS n FROM hash_v GROUP BY 1),
tot_v AS (SELECT *, ceil(round(sum(n) OVER () * 0.2e0, 9)) AS t, sum(n) OVER () AS a FROM cnt_v),
frac_v AS (SELECT *, floor(n * t / a) AS f, round(n * t / a - floor(n * t / a), 9) AS r FROM tot_v),
test_v AS (SELECT l, n, f + CASE WHEN row_number() OVER (ORDER BY r DESC, l) <= t - sum(f) OVER () THEN 1 ELSE 0 END AS n_test
           FROM frac_v),
rest_v AS (SELECT *, n - n_test AS m, ceil(round(sum(n - n_test) OVER () * 0.25e0, 9)) AS t, sum(n - n_test) OVER () AS a FROM test_v),
rfrac_v AS (SELECT *, floor(m * t / a) AS f, round(m * t / a - floor(m * t / a), 9) AS r FROM rest_v),
quota_v AS (SELECT l, n_test, f + CASE WHEN row_number() OVER (ORDER BY r DESC, l) <= t - sum(f) OVER () THEN 1 ELSE 0 END AS n_val
            FROM rfrac_v),
place_v AS (SELECT *, row_number() OVER (PARTITION BY high_value_user ORDER BY h, user_id) AS place FROM hash_v),
spl_v AS (SELECT place_v.*, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_val THEN 'validation' ELSE 'train' END AS split
          FROM place_v JOIN quota_v ON l = high_value_user)"""
)

FIXED = (
    LABELLED
    + """,
mom_v AS (SELECT avg(coalesce(engagement_score, 0)) AS me, stddev_pop(coalesce(engagement_score, 0)) AS se,
                 avg(coalesce(total_spent, 0)) AS ms, stddev_pop(coalesce(total_spent, 0)) AS ss FROM lab_v),
lin_v AS (SELECT lab_v.*, -2.0e0 + 1.6e0 * ((coalesce(engagement_score, 0) - me) / CASE WHEN se = 0 THEN 1 ELSE se END)
                 + 1.2e0 * ((coalesce(total_spent, 0) - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END) AS linear FROM lab_v, mom_v),
prob_v AS (SELECT *, round(1.0e0 / (1.0e0 + exp(-linear)), 4) AS p1 FROM lin_v),
fix_v AS (SELECT *, cast(p1 > 0.5e0 AS int) AS predicted, high_value_user AS y FROM prob_v)"""
)


def uniform(key: str, draw: int, seed: str = "42") -> str:
    block, slot = divmod(draw, 4)
    return f"(('0x' || substr(md5('{seed}:{block}:' || {key}), {1 + 8 * slot}, 8))::bigint / 4294967296.0e0)"


def poisson(u: str, rate: float) -> str:
    steps = ", ".join(f"{p!r}::double" for p in poisson_cdf(rate))
    return f"cast(len(list_filter([{steps}], lambda p: p <= {u})) AS bigint)"


def normal(u1: str, u2: str, mean: float, sd: float) -> str:
    return f"({mean} + {sd} * sqrt(-2.0e0 * ln(1.0e0 - {u1})) * cos(2 * pi() * {u2}))"


def exponential(u: str, scale: float) -> str:
    return f"(-{scale} * ln(1.0e0 - {u}))"


def choice(u: str, steps: list[tuple[str, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {limit}e0 THEN '{value}'" for value, limit in steps) + f" ELSE '{last}' END"


ASSIGNED = (
    FIXED
    + f""",
var_v AS (SELECT *, CASE WHEN {uniform("user_id", 0, "experiment")} > 0.5e0 THEN 'A' ELSE 'B' END AS variant FROM fix_v),
asg_v AS (SELECT *,
  CASE WHEN predicted = 1 THEN 'high_value' ELSE 'standard' END AS predicted_bucket,
  round(CASE WHEN predicted = 1 THEN p1 ELSE 1 - p1 END, 6) AS confidence,
  round(p1, 6) AS high_value_probability,
  round(1 - p1, 6) AS standard_probability,
  CASE WHEN predicted = 1 AND p1 > 0.8e0 THEN 'premium_features' WHEN predicted = 1 THEN 'engagement_boost'
       WHEN p1 > 0.3e0 THEN 'conversion_optimization' ELSE 'basic_features' END AS experiment_type,
  CASE WHEN predicted = 1 AND p1 > 0.8e0 THEN 'high' WHEN predicted = 1 OR p1 > 0.3e0 THEN 'medium' ELSE 'low' END AS priority,
  'unified_pipeline' AS model_version FROM var_v)"""
)
ASSIGNED_COLUMNS = (
    "predicted_bucket, confidence, high_value_probability, standard_probability, experiment_type, variant, priority, model_version"
)

CELLS = (
    FIXED
    + """,
cell_v AS (SELECT count(*) FILTER (y = 0 AND predicted = 0) AS tn, count(*) FILTER (y = 0 AND predicted = 1) AS fp,
                  count(*) FILTER (y = 1 AND predicted = 0) AS fn, count(*) FILTER (y = 1 AND predicted = 1) AS tp FROM fix_v),
bin_v AS (SELECT *, coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0) AS accuracy,
                 coalesce(tp / nullif(tp + fp, 0), 0) AS precision_1, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_1,
                 coalesce(tn / nullif(tn + fn, 0), 0) AS precision_0, coalesce(tn / nullif(tn + fp, 0), 0) AS recall_0 FROM cell_v),
met_v AS (SELECT *, coalesce(2 * precision_1 * recall_1 / nullif(precision_1 + recall_1, 0), 0) AS f1_1,
                 coalesce(2 * precision_0 * recall_0 / nullif(precision_0 + recall_0, 0), 0) AS f1_0 FROM bin_v)"""
)

AUC = (
    CELLS
    + """,
sco_v AS (SELECT p1, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM fix_v GROUP BY p1),
cum_v AS (SELECT *, sum(neg) OVER (ORDER BY p1) - neg AS before FROM sco_v),
auc_v AS (SELECT sum(pos * (before + neg / 2.0e0)) / nullif(sum(pos)::double * sum(neg)::double, 0) AS auc FROM cum_v)"""
)

FAULTY = (
    ENGAGED
    + """,
req_v AS (SELECT c_custkey, user_id,
  CASE WHEN c_custkey % 89 = 0 THEN 121 WHEN c_custkey % 97 = 0 THEN -1 ELSE age END AS age,
  CASE WHEN c_custkey % 83 = 0 THEN -5 ELSE session_count END AS session_count,
  CASE WHEN c_custkey % 79 = 0 THEN -0.5e0 ELSE avg_session_duration END AS avg_session_duration,
  page_views, purchase_history,
  CASE WHEN c_custkey % 73 = 0 THEN -1.0e0 ELSE total_spent END AS total_spent,
  CASE WHEN c_custkey % 71 = 0 THEN 1.5e0 ELSE engagement_score END AS engagement_score,
  CASE WHEN c_custkey % 67 = 0 THEN -0.1e0 ELSE historical_conversion_rate END AS historical_conversion_rate,
  CASE WHEN c_custkey % 5 = 0 THEN 'female' WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE gender END AS gender,
  CASE WHEN c_custkey % 61 = 0 THEN NULL ELSE location END AS location
  FROM eng_v)"""
)

_RULES = [
    ("age", "minimum", "age < 0"),
    ("age", "maximum", "age > 120"),
    ("session_count", "minimum", "session_count < 0"),
    ("avg_session_duration", "minimum", "avg_session_duration < 0"),
    ("page_views", "minimum", "page_views < 0"),
    ("purchase_history", "minimum", "purchase_history < 0"),
    ("total_spent", "minimum", "total_spent < 0"),
    ("engagement_score", "minimum", "engagement_score < 0"),
    ("engagement_score", "maximum", "engagement_score > 1"),
    ("historical_conversion_rate", "minimum", "historical_conversion_rate < 0"),
    ("historical_conversion_rate", "maximum", "historical_conversion_rate > 1"),
    ("gender", "type", "gender IS NULL"),
    ("location", "type", "location IS NULL"),
]

REVIEWS = """
reviews_v AS (
  SELECT d.doc_id AS row_key,
    CASE WHEN d.doc_id % 101 = 0 THEN '' WHEN d.doc_id % 103 = 0 THEN NULL ELSE cast(d.doc_id % 97 AS varchar) END AS customer_id,
    CASE WHEN d.doc_id % 97 = 13 OR d.doc_id % 7 = 0 THEN 'n/a' ELSE cast(1 + d.doc_id % 5 AS varchar) END AS star_rating,
    CASE WHEN d.doc_id % 19 = 0 THEN 'x' ELSE cast(d.doc_id % 11 AS varchar) END AS helpful_votes,
    cast(d.doc_id % 17 AS varchar) AS total_votes,
    CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE d.text END AS review_body,
    CASE WHEN l.quality = 1 THEN 'Y' ELSE 'N' END AS verified_purchase
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

BULK = """
reviews_v AS (
  SELECT l_orderkey * 1000 + l_linenumber AS row_key, cast(o_custkey AS varchar) AS customer_id,
    cast(1 + l_linenumber % 5 AS varchar) AS star_rating, cast(l_suppkey % 11 AS varchar) AS helpful_votes,
    cast(l_suppkey % 17 AS varchar) AS total_votes, l_returnflag || l_linestatus AS review_body,
    CASE WHEN l_returnflag = 'R' THEN 'N' ELSE 'Y' END AS verified_purchase
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _number(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '^[0-9]+$') THEN try_cast({column} AS double) END"


def totals(source: str = "reviews_v", name: str = "tot_v") -> str:
    return f"""
{name} AS (
  SELECT customer_id, count(*) AS review_count, avg({_number("star_rating")}) AS avg_rating,
    coalesce(sum({_number("helpful_votes")}), 0) AS helpful_votes, coalesce(sum({_number("total_votes")}), 0) AS total_votes,
    avg(length(coalesce(review_body, ''))) AS avg_review_length,
    count(*) FILTER (verified_purchase = 'Y') AS verified_purchases,
    count(*) FILTER (verified_purchase = 'Y') / count(*) AS verified_ratio
  FROM {source} WHERE customer_id IS NOT NULL AND customer_id <> '' GROUP BY customer_id)"""


TOTALS_OUTPUT = """SELECT customer_id, review_count, helpful_votes, total_votes, verified_purchases,
  round(avg_rating, 6) AS avg_rating, round(avg_review_length, 6) AS avg_review_length, round(verified_ratio, 6) AS verified_ratio
FROM tot_v WHERE avg_rating IS NOT NULL"""


def profile_rows(noise: bool) -> str:
    def u(draw: int) -> str:
        return uniform("user_id", draw)

    def drawn(draw: str, mean: str) -> str:
        return draw if noise else mean

    beta = f"list_sort([{u(9)}, {u(10)}, {u(11)}, {u(12)}])[2]"
    return f"""
sco_v AS (SELECT *, 'amz_user_' || customer_id AS user_id,
  0.3e0 * least(review_count / 10.0e0, 1.0e0) + 0.2e0 * (avg_rating / 5.0e0) + 0.2e0 * least(avg_review_length / 500.0e0, 1.0e0)
  + 0.3e0 * verified_ratio AS score FROM tot_v WHERE avg_rating IS NOT NULL),
beh_v AS (SELECT *,
  greatest(review_count * 2 + {drawn(poisson(u(4), 10), "10")}, 1) AS session_count,
  greatest(verified_purchases + {drawn(poisson(u(7), 2), "2")}, 0) AS purchase_history,
  180 + score * 300 + {drawn(exponential(u(5), 120), "120")} AS avg_session_duration,
  50 + score * 200 + {drawn(exponential(u(8), 100), "100")} AS price,
  {drawn(beta, "0.4e0")} AS beta FROM sco_v),
prof_v AS (SELECT user_id,
  greatest(18, least(80, cast(trunc(25 + score * 40 + {drawn(normal(u(2), u(3), 0, 5), "0")}) AS int))) AS age,
  {choice(u(0), [("M", "0.45"), ("F", "0.95")], "Other")} AS gender,
  {choice(u(1), [("US", "0.7"), ("UK", "0.85"), ("CA", "0.95")], "AU")} AS location,
  session_count, greatest(session_count * 3 + {drawn(poisson(u(6), 15), "15")}, 1) AS page_views, purchase_history,
  '' AS previous_experiments, review_count, helpful_votes AS helpful_votes_received,
  round(avg_session_duration, 6) AS avg_session_duration, round(purchase_history * price, 6) AS total_spent,
  round(score, 6) AS engagement_score, round(least(0.8e0, score * 0.6e0 + beta * 0.4e0), 6) AS historical_conversion_rate,
  round(avg_rating, 6) AS avg_rating_given, round(verified_ratio, 6) AS verified_purchase_ratio FROM beh_v)"""


def synthetic(ids: str) -> str:
    def u(draw: int) -> str:
        return uniform("id", draw)

    def entry(draw: int) -> str:
        return uniform("id || ':' || i", draw, "42:entry")

    text = (
        f"'exp_' || cast(1 + floor({entry(0)} * 10.0e0) AS int) || ':' || "
        + choice(entry(1), [("A", "0.333333333333"), ("B", "0.666666666667")], "C")
        + f" || ':' || CASE WHEN {entry(2)} < 0.5e0 THEN 'True' ELSE 'False' END"
    )
    return f"""
ids_v AS ({ids}),
drw_v AS (SELECT id, printf('user_%06d', id) AS user_id,
  greatest(18, least(80, cast(trunc({normal(u(0), u(1), 35, 12)}) AS int))) AS age,
  {choice(u(2), [("M", "0.48"), ("F", "0.96")], "Other")} AS gender,
  {choice(u(3), [("US", "0.4"), ("UK", "0.55"), ("CA", "0.65"), ("AU", "0.75"), ("DE", "0.9")], "FR")} AS location,
  {poisson(u(4), 15)} AS session_count, {exponential(u(5), 300)} AS avg_session_duration, {poisson(u(6), 25)} AS page_views,
  {poisson(u(7), 3)} AS purchase_history, {exponential(u(8), 200)} AS spend, {poisson(u(9), 1)} AS entries FROM ids_v),
spent_v AS (SELECT *, CASE WHEN purchase_history > 0 THEN spend ELSE 0 END AS total_spent,
  list_transform(range(1, entries + 1), lambda i: {text}) AS history FROM drw_v),
sraw_v AS (SELECT *, 0.3e0 * ln(1 + session_count) + 0.2e0 * ln(1 + avg_session_duration / 60.0e0)
                     + 0.3e0 * ln(1 + page_views) + 0.2e0 * ln(1 + total_spent) AS raw FROM spent_v),
syn_v AS (SELECT user_id, age, gender, location, session_count, page_views, purchase_history,
  array_to_string(history, '|') AS previous_experiments, round(avg_session_duration, 6) AS avg_session_duration,
  round(total_spent, 6) AS total_spent,
  round((raw - (SELECT min(raw) FROM sraw_v)) / ((SELECT max(raw) FROM sraw_v) - (SELECT min(raw) FROM sraw_v)), 6) AS engagement_score,
  round(CASE WHEN entries > 0 THEN len(list_filter(history, lambda h: h LIKE '%:True')) / entries ELSE 0 END, 6)
    AS historical_conversion_rate FROM sraw_v)"""


EXPOSURES = """
exp_v AS (SELECT user_id, 1 + cast(regexp_extract(props, '"k": *([0-9]+)', 1) AS int) % 10 AS number,
                 CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant,
                 bool_or(event_type = 'purchase') AS converted
          FROM events GROUP BY 1, 2, 3)"""

METRICS = """
points_v AS (SELECT ts, 'primary' AS variant_name, value * 100.0e0 AS latency,
                    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS err4xx FROM events)"""


def windows(period: str) -> str:
    return (
        METRICS
        + f""",
win_v AS (SELECT time_bucket(INTERVAL '{period}', ts) AS period_start, variant_name, avg(latency) AS avg_latency,
                 cast(sum(err4xx) AS bigint) AS errors, count(*) AS invocations FROM points_v GROUP BY 1, 2)"""
    )


def _alarm_from(source: str, period: str, value: str, breach: str, periods: int, last: str = "max(period_start)") -> str:
    return f""",
span_v AS (SELECT variant_name, min(period_start) AS first, {last} AS last FROM {source} GROUP BY 1),
spine_v AS (SELECT variant_name, unnest(generate_series(first, last, INTERVAL '{period}')) AS period_start FROM span_v),
dense_v AS (SELECT s.period_start, s.variant_name, w.{value} AS value
            FROM spine_v s LEFT JOIN {source} w ON w.period_start = s.period_start AND w.variant_name = s.variant_name),
brk_v AS (SELECT *, CASE WHEN {breach} THEN 1 ELSE 0 END AS breach FROM dense_v),
run_v AS (SELECT *, sum(breach) OVER r AS breaches, count(*) OVER r AS seen FROM brk_v
          WINDOW r AS (PARTITION BY variant_name ORDER BY period_start ROWS BETWEEN {periods - 1} PRECEDING AND CURRENT ROW))
SELECT strftime(period_start, '%Y-%m-%d %H:%M:%S') AS period_start, variant_name, round(cast(value AS double), 6) AS value,
  CASE WHEN seen < {periods} THEN 'INSUFFICIENT_DATA' WHEN breaches = {periods} THEN 'ALARM' ELSE 'OK' END AS state FROM run_v"""


def alarm(period: str, value: str, breach: str, periods: int, last: str = "max(period_start)") -> str:
    return "WITH" + windows(period) + _alarm_from("win_v", period, value, breach, periods, last)


# Heartbeats tick until six hours after the last event's hour; windows that end ten minutes before are closed.
_LAST_BEAT = "(SELECT date_trunc('hour', max(ts)) + INTERVAL '6 hours' - INTERVAL '15 minutes' FROM events)"


ANSWERED = (
    FAULTY
    + f""",
mom_v AS (SELECT avg(coalesce(engagement_score, 0)) AS me, stddev_pop(coalesce(engagement_score, 0)) AS se,
                 avg(coalesce(total_spent, 0)) AS ms, stddev_pop(coalesce(total_spent, 0)) AS ss FROM eng_v),
lin_v AS (SELECT req_v.*, -2.0e0 + 1.6e0 * ((coalesce(engagement_score, 0) - me) / CASE WHEN se = 0 THEN 1 ELSE se END)
                 + 1.2e0 * ((coalesce(total_spent, 0) - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END) AS linear FROM req_v, mom_v),
fix_v AS (SELECT *, round(1.0e0 / (1.0e0 + exp(-linear)), 4) AS p1, cast(round(1.0e0 / (1.0e0 + exp(-linear)), 4) > 0.5e0 AS int) AS predicted,
                 c_custkey % 53 <> 0 AS parses,
                 c_custkey % 53 <> 0 AND NOT ({" OR ".join(f"coalesce({bad}, false)" for _, _, bad in _RULES)}) AS ok FROM lin_v)"""
    + ASSIGNED[len(FIXED) :]
)

WINDOW_OUTPUT = """SELECT strftime(period_start, '%Y-%m-%d %H:%M:%S') AS period_start, variant_name,
  round(avg_latency, 6) AS avg_latency, errors, invocations FROM {}"""

_SCALED = ", ".join(
    f"round((coalesce({n}, 0)::double - (SELECT mean FROM scl_v WHERE feature = '{n}')) / (SELECT std FROM scl_v WHERE feature = '{n}'), 6) AS {n}"
    for n in _FEATURE_NAMES
)

_SCALED_EXACT = ", ".join(
    f"(coalesce({n}, 0)::double - (SELECT mean FROM scl_v WHERE feature = '{n}')) / (SELECT std FROM scl_v WHERE feature = '{n}') AS {n}_s"
    for n in ["age", "engagement_score", "gender_encoded"]
)

FIT_ON_TRAIN = ",\n".join(
    [
        SPLIT,
        derived("spl_v"),
        "trn_v AS (SELECT * FROM der_v WHERE split = 'train')",
        vocabulary("trn_v"),
        encoded("der_v"),
        scaler("(SELECT * FROM enc_v WHERE split = 'train')"),
    ]
)

# What a trained model says is not SQL's to know: these name the rows and relations that hold for any model.
_RELATIONS = f"""WITH {SPLIT} SELECT user_id, split, high_value_user AS target, 1 AS bucket_fits, 1 AS confidence_fits,
    1 AS sum_is_one, 1 AS experiment_fits, 1 AS priority_fits FROM spl_v"""

_SCORE = "round(1.0e0 / (1.0e0 + exp(-linear)), 4)"


def _gated(name: str, auc: str) -> str:
    return f"""SELECT '{name}' AS model_id, CASE WHEN approved THEN 'Approved' ELSE 'Model did not meet approval criteria' END AS status
        FROM (WITH {auc} SELECT accuracy >= 0.75e0 AND precision_1 >= 0.70e0 AND recall_1 >= 0.65e0
              AND coalesce(auc >= 0.80e0, false) AS approved FROM met_v, auc_v)"""


ORACLES: dict[str, str] = {
    "user_base": f"WITH {USERS} SELECT * FROM users_v",
    "engagement_minmax": f"WITH {ENGAGED} SELECT user_id, round(engagement_score, 6) AS engagement_score FROM eng_v",
    "high_value_label": f"""WITH {LABELLED} SELECT location, high_value_user, count(*) AS n_users,
        round(avg(engagement_score), 6) AS avg_engagement FROM lab_v GROUP BY 1, 2""",
    "label_distribution": f"WITH {LABELLED} SELECT high_value_user, count(*) AS n_users FROM lab_v GROUP BY 1",
    "value_tiers": f"WITH {USERS}, {derived('users_v')} SELECT user_id, age_group, spending_tier FROM der_v",
    "derived_ratios": f"""WITH {USERS}, {derived('users_v')} SELECT user_id, spend_per_purchase, session_efficiency
        FROM der_v""",
    "vocab_fit": f"WITH {USERS}, {derived('users_v')}, {vocabulary('der_v')} SELECT feature, value, idx FROM voc_v",
    "encode_unseen": f"""WITH {FAULTY}, {derived('eng_v')}, {vocabulary('der_v')}, {derived('req_v', 'rder_v')}, {encoded('rder_v')}
        SELECT user_id, gender_encoded, location_encoded, age_group_encoded, spending_tier_encoded FROM enc_v""",
    "scaler_fit": f"""WITH {ENGAGED}, {derived('eng_v')}, {vocabulary('der_v')}, {encoded('der_v')}, {scaler('enc_v')}
        SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM scl_v""",
    "feature_matrix": f"WITH {FIT_ON_TRAIN} SELECT user_id, split, high_value_user AS target, {_SCALED} FROM enc_v",
    "review_profile": f"WITH {REVIEWS}, {totals()} {TOTALS_OUTPUT}",
    "review_rejected": f"WITH {REVIEWS}, {totals()} SELECT customer_id, review_count FROM tot_v WHERE avg_rating IS NULL",
    "review_engagement": f"WITH {REVIEWS}, {totals()}, {profile_rows(False)} SELECT * FROM prof_v",
    "review_users_drawn": f"WITH {BULK}, {totals()}, {profile_rows(True)} SELECT * FROM prof_v",
    "customer_totals_first_seen": f"""WITH {BULK}, {totals()},
        first_v AS (SELECT customer_id, min(row_key) AS row_key FROM reviews_v GROUP BY 1)
        SELECT customer_id, review_count, row_key, round(avg_rating, 6) AS avg_rating FROM tot_v JOIN first_v USING (customer_id)""",
    "customers_first_seen": f"WITH {REVIEWS} SELECT customer_id, min(row_key) AS row_key FROM reviews_v GROUP BY 1",
    "event_stamps": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS compact,
        CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso
        FROM events""",
    "model_metadata": f"""WITH {SPLIT} SELECT 'logistic_regression' AS model_type,
        count(*) FILTER (split = 'train') AS training_samples, count(*) FILTER (split = 'validation') AS validation_samples,
        14 AS n_features, count(DISTINCT high_value_user) FILTER (split = 'train') AS n_classes, 42 AS random_state FROM spl_v""",
    "review_profile_bulk": f"WITH {BULK}, {totals()} {TOTALS_OUTPUT}",
    "top_up_union": f"""WITH {REVIEWS}, {totals()}, {profile_rows(False)},
        few_v AS (SELECT count(*) AS n FROM prof_v),
        {synthetic("SELECT range AS id FROM range(5000) WHERE range < (SELECT CASE WHEN n < 1000 THEN 5000 - n ELSE 0 END FROM few_v)")}
        SELECT * FROM prof_v UNION ALL BY NAME SELECT * FROM syn_v""",
    "history_text": f"""WITH {EXPOSURES} SELECT user_id, string_agg('exp_' || number || ':' || variant || ':' ||
        CASE WHEN converted THEN 'True' ELSE 'False' END, '|' ORDER BY number, variant, converted) AS previous_experiments
        FROM exp_v GROUP BY user_id""",
    "history_roundtrip": f"WITH {EXPOSURES} SELECT user_id, 'exp_' || number AS experiment, variant, converted FROM exp_v",
    "history_conversion": f"""WITH {EXPOSURES} SELECT user_id, round(count(*) FILTER (converted) / count(*), 6)
        AS historical_conversion_rate FROM exp_v GROUP BY user_id""",
    "stratified_split_sizes": f"WITH {SPLIT} SELECT split, high_value_user, count(*) AS n_users FROM spl_v GROUP BY 1, 2",
    "stratified_split_members": f"WITH {SPLIT} SELECT user_id, high_value_user, split FROM spl_v",
    "split_zones": f"""WITH {FIT_ON_TRAIN}, one_v AS (SELECT split, page_views, high_value_user, {_SCALED_EXACT} FROM enc_v)
        SELECT split, count(*) AS n_raw, cast(sum(page_views) AS bigint) AS page_views,
        count(*) AS n_scaled, cast(sum(high_value_user) AS bigint) AS n_high_value, round(sum(age_s), 4) + 0.0e0 AS age_scaled,
        round(sum(engagement_score_s), 4) + 0.0e0 AS engagement_score_scaled, round(sum(gender_encoded_s), 4) + 0.0e0 AS gender_encoded_scaled FROM one_v GROUP BY split""",
    "saved_pipeline": f"""WITH {SPLIT} SELECT split, high_value_user AS target, count(*) AS n_users, count(*) AS n_same,
        cast(0 AS bigint) AS n_odd FROM spl_v GROUP BY 1, 2""",
    "rf_quality": f"""WITH {SPLIT} SELECT 'random_forest' AS model_type, 100 AS n_estimators, 10 AS max_depth, 42 AS random_state,
        (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT cast(high_value_user AS varchar) AS c FROM spl_v WHERE split = 'train')) AS classes,
        '{",".join(_FEATURE_NAMES)}' AS feature_names,
        count(*) FILTER (split = 'train') AS training_samples, count(*) FILTER (split = 'validation') AS validation_samples,
        14 AS n_importances, 1 AS importances_sum_to_one, 1 AS accuracy_reached, 1 AS auc_reached, 1 AS tells_users_apart,
        count(*) FILTER (split = 'test') AS n_test FROM spl_v""",
    "stream_answer_tables": f"""WITH {ANSWERED} SELECT 'scored' AS kind, user_id, round(confidence, 6) AS confidence FROM asg_v WHERE ok
        UNION ALL SELECT 'refused', user_id, NULL FROM asg_v WHERE NOT ok UNION ALL SELECT 'captured', user_id, NULL FROM asg_v""",
    "validation_report": f"WITH {FAULTY} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{r}' AS rule, count(*) FILTER ({bad}) AS n_bad FROM req_v" for c, r, bad in _RULES
    ),
    "request_quarantine": f"""WITH {FAULTY} SELECT user_id,
        cast(NOT ({" OR ".join(f"coalesce({bad}, false)" for _, _, bad in _RULES)}) AS int) AS is_valid FROM req_v""",
    "unknown_values": f"""WITH {FAULTY} SELECT gender, count(*) AS n FROM req_v
        WHERE gender NOT IN ({", ".join(f"'{v}'" for v in GENDER_VALUES)}) GROUP BY gender""",
    "json_requests": f"""WITH {FAULTY} SELECT user_id, cast(age AS double) AS age, cast(session_count AS double) AS session_count,
        gender, round(engagement_score, 6) AS engagement_score FROM req_v WHERE c_custkey % 53 <> 0""",
    "json_quarantine": "SELECT concat('user_', lpad(cast(c_custkey AS varchar), 6, '0')) AS user_id FROM customer WHERE c_custkey % 53 = 0",
    "raw_zone_report": "SELECT count(*) AS n_read, count(*) AS n_reported FROM customer",
    "fixed_score": f"WITH {FIXED} SELECT user_id, p1, predicted, y FROM fix_v",
    "assign_experiment": f"WITH {ASSIGNED} SELECT user_id, {ASSIGNED_COLUMNS} FROM asg_v",
    "assignment_balance": f"WITH {ASSIGNED} SELECT experiment_type, variant, count(*) AS n_users FROM asg_v GROUP BY 1, 2",
    "score_with_index": f"""WITH {ASSIGNED} SELECT row_number() OVER (ORDER BY user_id) - 1 AS user_index, {ASSIGNED_COLUMNS}
        FROM asg_v""",
    "capture_sample": f"""WITH {ASSIGNED} SELECT user_id, age, predicted_bucket, variant FROM asg_v
        WHERE {uniform("user_id", 0, "capture")} < 0.25e0""",
    "confusion_matrix": f"""WITH {CELLS} SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cell_v UNION ALL SELECT 0, 1, fp FROM cell_v
        UNION ALL SELECT 1, 0, fn FROM cell_v UNION ALL SELECT 1, 1, tp FROM cell_v""",
    "binary_metrics": f"""WITH {CELLS} SELECT round(accuracy, 6) AS accuracy, round(precision_1, 6) AS "precision",
        round(recall_1, 6) AS recall, round(f1_1, 6) AS f1_score FROM met_v""",
    "roc_auc": f"WITH {AUC} SELECT round(auc, 6) AS auc FROM auc_v",
    "classification_report": f"""WITH {CELLS},
        rep_v AS (
          SELECT '0' AS class, precision_0 AS p, recall_0 AS r, f1_0 AS f, tn + fp AS support FROM met_v
          UNION ALL SELECT '1', precision_1, recall_1, f1_1, fn + tp FROM met_v
          UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, tn + fp + fn + tp FROM met_v
          UNION ALL SELECT 'macro avg', (precision_0 + precision_1) / 2, (recall_0 + recall_1) / 2, (f1_0 + f1_1) / 2,
                           tn + fp + fn + tp FROM met_v
          UNION ALL SELECT 'weighted avg', (precision_0 * (tn + fp) + precision_1 * (fn + tp)) / (tn + fp + fn + tp),
                           (recall_0 * (tn + fp) + recall_1 * (fn + tp)) / (tn + fp + fn + tp),
                           (f1_0 * (tn + fp) + f1_1 * (fn + tp)) / (tn + fp + fn + tp), tn + fp + fn + tp FROM met_v)
        SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM rep_v""",
    "business_metrics": f"""WITH {CELLS} SELECT tn + fp + fn + tp AS total_test_users, tp + fn AS actual_high_value_users,
        tp + fp AS predicted_high_value_users, tp AS correctly_identified_high_value,
        round(tp / greatest(tp + fp, 1), 6) AS bucketing_efficiency, round(tp / greatest(tp + fn, 1), 6) AS coverage,
        round(precision_1, 6) AS high_value_precision, round(recall_1, 6) AS high_value_recall FROM met_v""",
    "approval_decision": f"""WITH {AUC},
        pass_v AS (SELECT accuracy >= 0.75e0 AS a, precision_1 >= 0.70e0 AS p, recall_1 >= 0.65e0 AS r,
                          coalesce(auc >= 0.80e0, false) AS u FROM met_v, auc_v)
        SELECT cast(a AND p AND r AND u AS int) AS approve_model, cast(a AS int) AS accuracy_pass, cast(p AS int) AS precision_pass,
          cast(r AS int) AS recall_pass, cast(u AS int) AS auc_pass,
          CASE WHEN a AND p AND r AND u THEN 'All criteria met' ELSE 'Some criteria not met' END AS recommendation_reason FROM pass_v""",
    "metric_windows": f"WITH {windows('5 minutes')} {WINDOW_OUTPUT.format('win_v')}",
    "alarm_latency": alarm("1 hour", "avg_latency", "coalesce(value > 5000, false)", 2),
    "alarm_errors": alarm("1 hour", "errors", "coalesce(value > 4, false)", 2),
    "alarm_error_rate": alarm("1 hour", "errors", "coalesce(value > 10, false)", 2),
    "alarm_low_traffic": alarm("5 minutes", "invocations", "coalesce(value < 1, true)", 6),
    "latest_snapshot": f"""WITH {ENGAGED} SELECT user_id, age, gender, location, session_count,
        round(engagement_score, 6) AS engagement_score, round(total_spent, 6) AS total_spent FROM eng_v""",
    "review_tsv_scan": f"WITH {REVIEWS}, {totals()} {TOTALS_OUTPUT}",
    "dataset_selector": f"WITH {REVIEWS}, {totals()}, {profile_rows(False)} SELECT *, 'reviews' AS data_source FROM prof_v",
    "synthetic_users": f"WITH {synthetic('SELECT c_custkey AS id FROM customer')} SELECT * FROM syn_v",
    "stream_ingest": f"""WITH {ENGAGED} SELECT user_id, age, session_count, page_views, purchase_history, gender, location,
        round(avg_session_duration, 6) AS avg_session_duration, round(total_spent, 6) AS total_spent,
        round(engagement_score, 6) AS engagement_score, round(historical_conversion_rate, 6) AS historical_conversion_rate,
        cast(NULL AS varchar) AS _corrupt_record FROM eng_v""",
    "stream_score": f"WITH {ANSWERED} SELECT user_id, {ASSIGNED_COLUMNS} FROM asg_v WHERE ok",
    "stream_answers": f"""WITH {ANSWERED} SELECT CASE WHEN ok THEN 'scored' ELSE 'refused' END AS status, count(*) AS n_requests
        FROM asg_v GROUP BY 1""",
    "stream_capture": f"""WITH {ANSWERED} SELECT user_id, CASE WHEN ok THEN 'scored' ELSE 'refused' END AS status,
        CASE WHEN parses THEN location END AS location, CASE WHEN parses THEN cast(page_views AS double) END AS page_views,
        CASE WHEN ok THEN predicted_bucket END AS predicted_bucket, CASE WHEN ok THEN confidence END AS confidence,
        CASE WHEN ok THEN variant END AS variant FROM asg_v""",
    "stream_metrics": f"WITH {windows('1 hour')} {WINDOW_OUTPUT.format('win_v')}",
    "stream_silence": alarm("5 minutes", "invocations", "coalesce(value < 1, true)", 6, _LAST_BEAT),
    "stream_error_log": alarm("5 minutes", "errors", "coalesce(value > 0, false)", 2, _LAST_BEAT),
    "stream_alarms": alarm("5 minutes", "invocations", "coalesce(value < 1, true)", 6),
    "rf_scores": _RELATIONS,
    "lr_scores": _RELATIONS,
    "lr_gradient": "SELECT unnest(["
    + ", ".join(f"'{name}'" for name in [*_FEATURE_NAMES, "intercept"])
    + "]) AS feature, 0.0e0 AS gradient",
    "rf_importance_top5": "SELECT cast(range AS int) AS rank, 1 AS is_feature, 1 AS falls, 1 AS sum_is_one FROM range(1, 6)",
    "model_evaluation": f"""WITH {SPLIT} SELECT count(*) AS n_test, count(*) FILTER (high_value_user = 1) AS n_high_value,
        1 AS ranks_well FROM spl_v WHERE split = 'test'""",
    "registry_gate": f"""{_gated("fixed", AUC)} UNION ALL {_gated("reversed", AUC.replace(_SCORE, f"round(1.0e0 - {_SCORE}, 4)"))}""",
}
