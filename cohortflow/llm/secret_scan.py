"""Secret scans in DataFrame operations only: three fixed patterns and a battery of randomness tests.

The patterns give the base spans. The battery looks at unbroken runs of at least ``MIN_TOKEN`` key characters that mix
letters and digits, and at their parts: a value behind a name, a piece of a path, what stands between dashes. The
alphabet of a run or a part (its encoding) is inferred from the characters it holds; three statistics
ask whether it could be uniform noise over that alphabet: the chi-squared sum of its character counts, the number
of runs above and below the middle of the alphabet, and the correlation of neighbours. Squared and added, they give
one probability. Ordinary words of as many letters serve as decoys: per band of lengths, the lowest probability is
accepted at which the decoys' rate, carried over to all candidates, leaves a false share of at most ``FALSE_SHARE``.
Longer runs are told apart more easily, so they get a lower bar. All counts cover all texts, and parts as well as runs.
Where a band has fewer than ``LEAST_DECOYS`` words, shorter ones are taken as well, or fixed rates of English prose make up
the number, whichever gives the lower bar; so a small table is judged like a large one.

Work in a text grows by n to the power of 1.5 in its matches and in proportion to the length of a run.

Defined results: a null or empty text has no spans; spans are in code points, the end exclusive, sorted by start and
then by kind; a run or part that a base span touches is not reported again, nor a part of a reported one; equal rows get equal results; other columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three patterns. A run of hex digits or key characters is maximal, so a length bound in the
# pattern is the same as dropping short matches; an assignment keeps its bound apart, since a dropped one uses up text.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20


def _mixed(marks: str, padding: str = "") -> str:
    """Runs of letters, digits and ``marks`` with a digit and a letter, not a part of a longer run."""
    return (
        rf"(?<![A-Za-z0-9{marks}])(?=[A-Za-z{marks}]*[0-9])(?=[0-9{marks}]*[A-Za-z])[A-Za-z0-9{marks}]{{{MIN_TOKEN},}}{padding}"
    )


CANDIDATE = _mixed("+/_=-")
#: Parts of a run: cut at '=' other than trailing padding, at '/' as well, and at all marks between names.
PARTS = tuple(_mixed(marks, "(?:={1,2}(?![A-Za-z0-9+/_=-]))?") for marks in ("+/_-", "+_-", "+"))
DECOY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{16,}(?![A-Za-z0-9+/_=-])"
SENTENCE_WORD = "^[A-Z]?[a-z]+$"
#: Lengths at which a band begins. A band with too few decoys is judged by those of shorter bands or by reference rates.
BANDS = (16, 20, 24, 32, 48)
FALSE_SHARE = 0.05
LEAST_DECOYS = 400
PROBABILITY_STEPS = 200
# Shares of runs of neighbouring English words, 4,000 per band, that reach a probability.
REFERENCE_LEVELS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)
REFERENCE_RATES = (
    (0.7328, 0.6873, 0.6295, 0.5398, 0.4540, 0.3418, 0.2660, 0.1640, 0.0483),
    (0.5740, 0.5153, 0.4620, 0.3715, 0.2813, 0.1855, 0.1383, 0.0715, 0.0220),
    (0.3218, 0.2698, 0.2165, 0.1558, 0.1058, 0.0625, 0.0363, 0.0160, 0.0020),
    (0.0543, 0.0423, 0.0258, 0.0133, 0.0075, 0.0038, 0.0018, 0.0010, 0.0000),
    (0.0005, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000, 0.0000),
)

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, from narrow to wide: the pattern of a whole run and its alphabet.
ENCODINGS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"^[0-9A-Za-z]+$", _DIGITS + _LOWER + _UPPER),
)
WIDEST = _DIGITS + _LOWER + _UPPER + "+/-_="


SPAN = "struct<start:int,place:int,end:int,kind:string>"


def running(values: Column, combine) -> Column:
    """Per place of an array of longs, ``combine`` of all values before it, from 0.

    Added up by blocks of about the square root of the size: array functions have no running sum, and one that grows an
    array by a value at a time copies it each time.
    """
    fold = lambda part: F.aggregate(part, F.lit(0).cast("long"), combine)
    # Each step is bound by a lambda, so that it is worked out once and not at each place.
    one = F.array(F.struct(values.alias("v"), F.ceil(F.sqrt(F.size(values))).cast("int").alias("w")))
    block = lambda x, b: fold(F.slice(x["v"], b * x["w"] + 1, x["w"]))
    one = F.transform(one, lambda x: F.struct(x["v"], x["w"], F.transform(F.sequence(F.lit(0), _div(F.size(x["v"]) - 1, x["w"])), lambda b: block(x, b)).alias("sums")))
    one = F.transform(one, lambda x: F.struct(x["v"], x["w"], F.transform(x["sums"], lambda _, b: fold(F.slice(x["sums"], F.lit(1), b))).alias("before")))
    inside = lambda x, i: fold(F.slice(x["v"], _div(i, x["w"]) * x["w"] + 1, i % x["w"]))
    one = F.transform(one, lambda x: F.transform(x["v"], lambda _, i: combine(F.get(x["before"], _div(i, x["w"])), inside(x, i))))
    return F.when(F.size(values) > 0, F.element_at(one, 1)).otherwise(F.array().cast("array<bigint>"))


def _div(number: Column, by) -> Column:
    return F.floor(number / by).cast("int")


def _sum(total, value):
    return total + value


def pattern_matches(text: Column, pattern: str, kind: str, passes=None) -> Column:
    """Array of (start, place of the kind, end, kind, token) of the pattern's matches that ``passes``.

    The stretches between matches and the matches themselves add up to the positions.
    """
    # The stretch behind the last match has no match of its own.
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    one = F.transform(F.array(parts), lambda p: F.filter(p, lambda part: part["match"].isNotNull()))
    sizes = lambda p: F.transform(p, lambda part: (F.length(part["gap"]) + F.length(part["match"])).cast("long"))
    one = F.transform(one, lambda p: F.arrays_zip(p.alias("part"), running(sizes(p), _sum).alias("before")))
    one = F.filter(F.element_at(one, 1), lambda z: passes(z["part"]["match"]) if passes else F.lit(True))

    def span(z):
        first = (z["before"] + F.length(z["part"]["gap"])).cast("int")
        last = first + F.length(z["part"]["match"])
        return F.struct(
            first.alias("start"), F.lit(KINDS.index(kind)).alias("place"), last.alias("end"), F.lit(kind).alias("kind"), z["part"]["match"].alias("token")
        )

    found = F.transform(one, span)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN[:-1]},token:string>>"))


def pattern_spans(text: Column, pattern: str, kind: str, passes=None) -> Column:
    """``pattern_matches`` without the tokens."""
    return F.transform(pattern_matches(text, pattern, kind, passes), lambda m: F.struct(m["start"], m["place"], m["end"], m["kind"]))


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, by start and then by kind."""
    long_value = lambda match: F.length(F.regexp_extract(match, ASSIGN, 1)) >= ASSIGN_VALUE
    return F.array_sort(
        F.concat(
            pattern_spans(text, ASSIGN, "assign", long_value),
            pattern_spans(text, ACCESS, "access"),
            pattern_spans(text, HEX, "hex"),
        )
    )


def _alphabet(token: Column) -> Column:
    choice = F.lit(WIDEST)
    for pattern, alphabet in reversed(ENCODINGS):
        choice = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(choice)
    return choice


def noise_probability(token: str, alphabet: str) -> str:
    """SQL, also for use in a lambda: how likely uniform noise deviates at least as much as this run.

    Each statistic is standardised by its mean and variance under noise; the sum of the three squares has about a
    chi-squared distribution with three degrees of freedom.
    """
    return f"""element_at(transform(transform(transform(transform(array(named_struct('t', {token}, 'a', {alphabet}, 's', split({token}, ''))),
        x -> named_struct('n', cast(length(x.t) as double), 'm', cast(length(x.a) as double), 't', x.t, 's', x.s,
          'c', transform(x.s, ch -> cast(locate(ch, x.a) as double)))),
        x -> named_struct('n', x.n, 'm', x.m, 'c', x.c,
          'mean', aggregate(x.c, 0D, (s, v) -> s + v) / x.n,
          'squares', aggregate(array_distinct(x.s), 0D, (s, ch) -> s + pow(x.n - length(replace(x.t, ch, '')), 2)),
          'high', cast(size(filter(x.c, v -> v > x.m / 2)) as double),
          'turns', 1D + aggregate(sequence(2, cast(x.n as int)), 0D, (s, i) ->
             s + if((element_at(x.c, i) > x.m / 2) <> (element_at(x.c, i - 1) > x.m / 2), 1D, 0D)))),
        x -> named_struct(
          'chi', (x.squares * x.m / x.n - x.n - (x.m - 1)) / sqrt(2D * (x.m - 1) * (1D - 1D / x.n)),
          'runs', (x.turns - 1D - 2D * x.high * (x.n - x.high) / x.n)
             / sqrt(greatest(1D, 2D * x.high * (x.n - x.high) * (2D * x.high * (x.n - x.high) - x.n) / (x.n * x.n * (x.n - 1D)))),
          'serial', coalesce(sqrt(x.n) * aggregate(sequence(2, cast(x.n as int)), 0D, (s, i) ->
             s + (element_at(x.c, i) - x.mean) * (element_at(x.c, i - 1) - x.mean))
             / nullif(aggregate(x.c, 0D, (s, v) -> s + pow(v - x.mean, 2)), 0D), sqrt(x.n)))),
        x -> element_at(transform(array(x.chi * x.chi + x.runs * x.runs + x.serial * x.serial), q ->
          element_at(transform(array(1D / (1D + 0.3275911D * sqrt(q / 2D))), k ->
            exp(-q / 2D) * (k * (0.254829592D + k * (-0.284496736D + k * (1.421413741D + k * (-1.453152027D + k * 1.061405429D))))
            + sqrt(2D * q / pi()))), 1)), 1)), 1)"""


def _band(length: Column) -> Column:
    band = F.lit(0)
    for place, least in enumerate(BANDS):
        band = F.when(length >= least, place).otherwise(band)
    return band


def acceptance(docs: DataFrame, text: str = "text") -> list[float]:
    """Per band of lengths, the lowest noise probability at which a run counts as random; above 1 if none does."""
    runs_and_parts = F.flatten(
        F.transform(
            F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)),
            lambda t: F.array_distinct(F.concat(F.array(t), *[F.regexp_extract_all(t, F.lit(part), F.lit(0)) for part in PARTS])),
        )
    )
    candidates = F.transform(
        runs_and_parts,
        lambda t: F.struct(t.alias("token"), _alphabet(t).alias("alphabet"), F.lit(False).alias("decoy")),
    )
    # A word stands for a run of its letters with digits mixed in, so the alphabet holds digits.
    decoys = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(DECOY), F.lit(0)),
        lambda t: F.struct(
            F.when(t.rlike(SENTENCE_WORD), F.lower(t)).otherwise(t).alias("token"),
            F.when(t.rlike(SENTENCE_WORD), F.lit(_DIGITS + _LOWER))
            .when(t.rlike("^[A-Z]+$"), F.lit(_DIGITS + _UPPER))
            .otherwise(F.lit(_DIGITS + _LOWER + _UPPER))
            .alias("alphabet"),
            F.lit(True).alias("decoy"),
        ),
    )
    runs = docs.where(F.col(text).rlike(CANDIDATE) | F.col(text).rlike(DECOY)).select(
        F.explode(F.concat(candidates, decoys)).alias("run")
    )
    runs = runs.select("run.*")
    level = F.floor(F.expr(noise_probability("token", "alphabet")) * PROBABILITY_STEPS).cast("int")
    counts = (
        runs.groupBy(_band(F.length("token")).alias("band"), "decoy", F.least(level, F.lit(PROBABILITY_STEPS - 1)).alias("level"))
        .count()
        .collect()  # bands times levels at most
    )
    passing = {decoy: [[0] * (PROBABILITY_STEPS + 1) for _ in BANDS] for decoy in (False, True)}
    for row in counts:
        passing[row["decoy"]][row["band"]][max(0, row["level"])] += row["count"]
    for bands in passing.values():
        for levels in bands:
            for place in range(PROBABILITY_STEPS - 1, -1, -1):
                levels[place] += levels[place + 1]
    bars = []
    for place in range(len(BANDS)):
        found = passing[False][place]
        # Words of the band, with those of the bands below while they are too few: shorter, so stricter.
        words = [0] * (PROBABILITY_STEPS + 1)
        for below in range(place, -1, -1):
            if words[0] < LEAST_DECOYS:
                words = [a + b for a, b in zip(words, passing[True][below])]
        # Or those of the band alone, with the reference for what is missing.
        own = passing[True][place]
        missing = max(0, LEAST_DECOYS - own[0])
        filled = [own[level] + missing * _reference_rate(place, level / PROBABILITY_STEPS) for level in range(PROBABILITY_STEPS + 1)]
        filled[0] = own[0] + missing
        bars.append(min(_bar(found, words), _bar(found, filled)))
    return bars


def _bar(found: list, decoys: list) -> float:
    """The lowest probability at which the decoys' rate leaves a small enough false share; above 1 if none does."""
    for level in range(1, PROBABILITY_STEPS):
        false = (decoys[level] + 1) / (decoys[0] + 1) * found[0]
        if found[level] and false <= FALSE_SHARE * found[level]:
            return level / PROBABILITY_STEPS
    return 2.0


def _reference_rate(band: int, probability: float) -> float:
    """The share of reference runs that reach the highest listed probability up to this one; all below the first."""
    rates = [rate for level, rate in zip(REFERENCE_LEVELS, REFERENCE_RATES[band]) if level <= probability + 1e-9]
    return rates[-1] if rates else 1.0


def _untouched(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (start, place, end, kind, token) that overlap none of ``others`` (start, place, end, kind).

    In one order by start, a span is touched from before if an end that was reached is behind its start, and from
    behind if a start is before its end: running maxima over the order and over its reverse.
    """
    joined = F.array_sort(
        F.concat(
            F.transform(others, lambda o: F.struct(o["start"], F.lit(0).alias("own"), o["end"], F.lit(None).cast("struct<start:int,place:int,end:int,kind:string,token:string>").alias("span"))),
            F.transform(spans, lambda r: F.struct(r["start"], F.lit(1).alias("own"), r["end"], r.alias("span"))),
        )
    )
    latest = lambda a, v: F.greatest(a, v)
    ends = lambda x: running(F.transform(x, lambda p: F.when(p["own"] == 0, p["end"]).otherwise(0).cast("long")), latest)
    # Negative starts, counted from the end: the greatest is the earliest start that follows.
    least = -(1 << 40)
    starts = lambda x: F.reverse(running(F.reverse(F.transform(x, lambda p: F.when(p["own"] == 0, F.lit(1 << 40) - p["start"]).otherwise(0).cast("long"))), latest))
    one = F.transform(F.array(joined), lambda x: F.arrays_zip(x.alias("p"), ends(x).alias("reached"), starts(x).alias("follows")))
    free = F.filter(
        F.element_at(one, 1),
        lambda z: (z["p"]["own"] == 1) & (z["reached"] <= z["p"]["start"]) & ((z["follows"] == 0) | (z["follows"] + least <= -z["p"]["end"])),
    )
    return F.when(F.size(spans) == 0, spans).otherwise(F.transform(free, lambda z: z["p"]["span"]))


def _widest(spans: Column) -> Column:
    """Spans (start, end, ...) that lie in no other one, each once. Two of them are apart or one holds the other."""
    order = F.array_sort(F.transform(spans, lambda r: F.struct(r["start"], (-r["end"]).alias("behind"), r.alias("span"))))
    reached = lambda x: running(F.transform(x, lambda p: (-p["behind"]).cast("long")), lambda a, v: F.greatest(a, v))
    one = F.transform(F.array(order), lambda x: F.arrays_zip(x.alias("p"), reached(x).alias("reached")))
    return F.transform(F.filter(F.element_at(one, 1), lambda z: z["reached"] < -z["p"]["behind"]), lambda z: z["p"]["span"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with ``scanned``, the text, ``base``, the pattern spans, and ``extra``, the battery's.

    The bars come from one pass over all texts before; a run or part that a base span touches is left out of ``extra``.
    """
    bars = acceptance(docs, text)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("scanned"))
    rows = rows.withColumn("base", base_spans(F.col("scanned")))
    every = F.concat(*[pattern_matches(F.col("scanned"), pattern, "random") for pattern in (CANDIDATE, *PARTS)])
    none = F.array().cast(f"array<{SPAN[:-1]},token:string>>")
    rows = rows.withColumn("extra", F.when(F.col("scanned").rlike(CANDIDATE), _each_once(every)).otherwise(none))
    rows = rows.withColumn("extra", F.when(F.size("base") > 0, _untouched(F.col("extra"), F.col("base"))).otherwise(F.col("extra")))
    rows = rows.withColumn("runs", F.transform("extra", lambda r: F.struct(r.alias("span"), r["token"].alias("token"), _alphabet(r["token"]).alias("alphabet"))))
    bar = " ".join(f"when length(r.token) >= {least} then {bar}D" for least, bar in reversed(list(zip(BANDS, bars))))
    rows = rows.withColumn("runs", F.expr(f"filter(runs, r -> {noise_probability('r.token', 'r.alphabet')} >= case {bar} end)"))
    # The widest of those that pass: a part of a passing run says nothing more.
    rows = rows.withColumn("passing", F.transform("runs", lambda r: F.struct(r["span"]["start"], r["span"]["place"], r["span"]["end"], r["span"]["kind"])))
    return rows.select("row", "scanned", "base", F.array_sort(_widest(F.col("passing"))).alias("extra"))


def _each_once(spans: Column) -> Column:
    """``spans`` sorted, each once."""
    one = F.transform(F.array(F.array_sort(spans)), lambda x: F.filter(x, lambda r, i: (i == 0) | (F.get(x, F.greatest(i - 1, F.lit(0))) != r)))
    return F.element_at(one, 1)


#: Code points that a text is cut into, in two steps, so that a stretch is found without reading from the start.
COARSE, FINE = 1 << 18, 1 << 11


def _stretches(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each of the sorted ``spans`` that begins outside those before it."""
    pieces = lambda t, size: F.transform(F.sequence(F.lit(0), _div(F.greatest(F.length(t) - 1, F.lit(0)), F.lit(size))), lambda k: F.substring(t, k * size + 1, F.lit(size)))
    cut = F.flatten(F.transform(pieces(text, COARSE), lambda part: pieces(part, FINE)))
    reached = running(F.transform(spans, lambda s: s["end"].cast("long")), lambda a, v: F.greatest(a, v))
    one = F.array(F.struct(cut.alias("cut"), F.arrays_zip(spans.alias("s"), reached.alias("at")).alias("steps"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("end")))

    def between(x, low, high):
        first, last = _div(low, F.lit(FINE)), _div(high, F.lit(FINE))
        piece = lambda k: F.coalesce(F.get(x["cut"], k), F.lit(""))
        near = F.substring(piece(first), low % FINE + 1, high - low)
        far = F.concat(
            F.substring(piece(first), low % FINE + 1, F.lit(FINE)),
            F.array_join(F.slice(x["cut"], first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(piece(last), F.lit(1), high % FINE),
        )
        return F.when(first == last, near).otherwise(far)

    def step(x, z):
        at = z["at"].cast("int")
        return F.when(z["s"]["start"] >= at, F.concat(between(x, at, z["s"]["start"]), F.lit(mark))).otherwise(F.lit(""))

    one = F.transform(one, lambda x: F.concat(F.array_join(F.transform(x["steps"], lambda z: step(x, z)), ""), between(x, x["end"], F.length(text))))
    return F.element_at(one, 1)


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of every span; null texts stay null, other columns as they are."""
    rows = scan(docs, text).withColumn("spans", F.array_sort(F.concat("base", "extra")))
    # Spans of different kinds can overlap: what lies before the end of an earlier one is not copied again.
    changed = F.when(F.size("spans") > 0, _stretches(F.col("scanned"), F.col("spans"), mark)).otherwise(F.col("row")[text])
    return rows.select(*[changed.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def digest_text(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
