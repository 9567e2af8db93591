"""Operator 3: secret scans.

Base kinds are three patterns.  Beside them, every long run of key characters is
put to a battery of randomness tests under the alphabet it seems to be written
in (digits, hex, base32, base36, base58, base62, either base64): chi-squared
uniformity of its letters, for digits also of their steps, a runs test about the
alphabet's middle and the lag-1 serial correlation.  A run is reported when no test of the
battery speaks against randomness and its uniformity is too good for ordinary
text.  The p-values of the latter go through a weighted step-up procedure over all
runs of the table, whose weights follow the length of the runs up to a bound, so that
short runs, on which chance says little, need more evidence: of all runs reported, a share of
``level`` at most is expected to be ordinary text.

A first pass counts the weighted p-values in steps of an eighth of their logarithm;
the step-up procedure runs over these counts, rounded against discovery, and its one
bar is held against every run in the second pass, which is row-local.  What the battery
finds in texts with such runs is written to the shared folder between the passes.

Defined results.  Null text scans as the empty text.  Offsets are code points,
end exclusive.  Repeated rows and null ids give a row each; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis.llm.common import durable, joined, let, located, table

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ with 24 or more characters
KINDS = ("assign", "access", "hex", "random")

#: Runs of key characters that the battery judges.
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: Chance that two letters of ordinary text agree (English, about 0.067), and
#: the same among its letters a to f alone.
TEXT_COINCIDENCE = 0.0667
HEX_COINCIDENCE = 0.26
#: Taken for digits of dates, counts and padded numbers.
DIGIT_COINCIDENCE = 0.2
DIGITS = "0123456789"
HEX_LOWER = "0123456789abcdef"
HEX_UPPER = "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LOWER36 = "0123456789abcdefghijklmnopqrstuvwxyz"
UPPER36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
UPPER = BASE32[:26]
LOWER = UPPER.lower()
BASE62 = UPPER + LOWER + DIGITS
BASE58 = "".join(c for c in BASE62 if c not in "0OIl")
BASE64, BASE64_URL, BASE64_BOTH = BASE62 + "+/", BASE62 + "-_", BASE62 + "+/_-"
#: Runs from this length on that lack some letters of a larger alphabet are of the smaller one.
LONG = 60
#: Length from which a run's weight grows no more.
WEIGHED = 30
#: Steps to a unit of the logarithm, in which p-values are counted.
STEPS = 8


def normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal, by the logistic form of Bowling et al."""
    return 1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))


def battery(runs: Column) -> Column:
    """Adds to each run its encoding and the tests' p-values."""

    def alphabet(m: Column) -> Column:
        long, marks = F.length(m) >= LONG, F.regexp_count(m, F.lit("[+/_-]"))
        return (
            F.when(m.rlike("^[0-9]+$"), F.lit(DIGITS))
            .when(m.rlike("^[0-9a-f]+$"), F.lit(HEX_LOWER))
            .when(m.rlike("^[0-9A-F]+$"), F.lit(HEX_UPPER))
            .when(long & m.rlike("^[A-Z]+$"), F.lit(UPPER))
            .when(long & m.rlike("^[a-z]+$"), F.lit(LOWER))
            .when(m.rlike("^[A-Z2-7]+$"), F.lit(BASE32))
            .when(m.rlike("^[0-9a-z]+$"), F.lit(LOWER36))
            .when(m.rlike("^[0-9A-Z]+$"), F.lit(UPPER36))
            .when(long & m.rlike("^[A-Za-z]+$"), F.lit(UPPER + LOWER))
            .when(long & m.rlike("^[1-9A-HJ-NP-Za-km-z]+$"), F.lit(BASE58))
            # Marks far rarer than base64 has them join parts of base62.
            .when(marks * 64 < F.length(m), F.lit(BASE62))
            .when(m.rlike("^[A-Za-z0-9+/]+$"), F.lit(BASE64))
            .when(m.rlike("^[A-Za-z0-9_-]+$"), F.lit(BASE64_URL))
            .otherwise(F.lit(BASE64_BOTH))
        )

    def judge(s: Column) -> Column:
        return let(alphabet(s["match"]), lambda letters: spelled(s, letters))

    def spelled(s: Column, letters: Column) -> Column:
        chars = F.filter(F.split(s["match"], ""), lambda c: c != "")
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.length(letters).cast("double").alias("k"),
            F.filter(F.transform(chars, lambda c: F.instr(letters, c).cast("double")), lambda v: v > 0).alias("x"),
        )

    def same_in(x: Column) -> Column:
        """The sum of the squared counts of the values of x."""
        return F.aggregate(
            F.array_distinct(x),
            F.lit(0.0),
            lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)),
        )

    def measure(s: Column) -> Column:
        mean = F.aggregate(s["x"], F.lit(0.0), lambda a, v: a + v) / F.size(s["x"])
        return let(mean, lambda m: about(s, m))

    def about(s: Column, mean: Column) -> Column:
        x, k = s["x"], s["k"]
        n = F.size(x).cast("double")
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        # Counted-up digits are even, but each differs from the next by the same.
        steps = F.when(k == 10, let(F.transform(pairs, lambda p: F.pmod(p["b"] - p["a"], k)), lambda d: k / (n - 1) * same_in(d) - (n - 1))).otherwise(0.0)
        spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        high = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v > k / 2, 1.0).otherwise(0.0))
        turns = F.aggregate(pairs, F.lit(1.0), lambda a, p: a + F.when((p["a"] > k / 2) != (p["b"] > k / 2), 1.0).otherwise(0.0))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            n.alias("n"),
            k.alias("k"),
            (k / n * same_in(x) - n).alias("chi2"),
            steps.alias("steps"),
            (F.when(spread > 0, lagged / spread).otherwise(1.0) * F.sqrt(n)).alias("serial_z"),
            high.alias("high"),
            turns.alias("turns"),
        )

    def decide(s: Column) -> Column:
        n, k = s["n"], s["k"]
        # As random letters: the chi-squared statistic has mean k - 1.
        random_z = (F.greatest(s["chi2"], s["steps"]) - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        expected = 2 * s["high"] * (n - s["high"]) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        runs_z = F.when(variance > 0, (s["turns"] - expected) / F.sqrt(variance)).otherwise(99.0)
        least = F.least(
            normal_tail(F.least(random_z, F.lit(30.0))),
            2 * normal_tail(F.least(F.abs(runs_z), F.lit(30.0))),
            2 * normal_tail(F.least(F.abs(s["serial_z"]), F.lit(30.0))),
        )
        # As ordinary text: letters agree more often, so the mean is higher by n * (k * coincidence - 1).
        agree = F.when(k == 16, HEX_COINCIDENCE).when(k == 10, DIGIT_COINCIDENCE).otherwise(TEXT_COINCIDENCE)
        surplus = n * F.greatest(k * agree - 1, F.lit(0.0))
        text_z = (k - 1 + surplus - s["chi2"]) / F.sqrt(2 * (k - 1 + 2 * surplus))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            n.alias("n"),
            F.least(F.lit(1.0), 3 * least).alias("p_random"),
            normal_tail(F.least(F.greatest(text_z, F.lit(-30.0)), F.lit(30.0))).alias("p_text"),
        )

    known = F.filter(F.transform(runs, judge), lambda s: F.size(s["x"]) > 1)
    return F.transform(F.transform(known, measure), decide)


def _weight(s: Column) -> Column:
    return F.least(s["n"], F.lit(float(WEIGHED)))


def _step_of(s: Column) -> Column:
    """The step of a run's p-value divided by its weight."""
    return F.floor(-F.log(F.greatest(s["p_text"] / _weight(s), F.lit(1e-300))) * STEPS).cast("int")


def bar_of(tested: DataFrame, level: float) -> DataFrame:
    """Rows ``tested`` (arrays of runs) to one row: the least step at which the
    weighted step-up procedure over all runs keeps a run."""
    counts = tested.select(F.explode("tested").alias("s")).groupBy(_step_of(F.col("s")).alias("step")).agg(
        F.count("*").alias("c"), F.sum(_weight(F.col("s"))).alias("n")
    )
    # Some thousand steps at most, however large the table is.
    everything = Window.partitionBy()
    upper = F.exp(-F.col("step") / STEPS) * F.sum("n").over(everything) / F.sum("c").over(everything)
    reached = F.sum("c").over(Window.orderBy(F.desc("step")))
    kept = counts.withColumn("keeps", upper * F.sum("c").over(everything) <= F.lit(level) * reached)
    return kept.agg(F.coalesce(F.min(F.when(F.col("keeps"), F.col("step"))), F.lit(1 << 30)).alias("__secret_bar"))


def discoveries(tested: Column, bar: Column, doubt: float) -> Column:
    """The runs that reach the bar, without those that the battery finds unlike
    random letters."""
    return F.filter(tested, lambda s: (_step_of(s) >= bar) & (s["p_random"] >= doubt))


def _ranked(found: Column, nth: int) -> Column:
    return F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"))
    )


def scan(docs: DataFrame, text: str = "text", level: float = 0.05, doubt: float = 0.001, into: str = "spans") -> DataFrame:
    """All rows and columns of ``docs`` with ``into``: an array of
    (kind, start, end) by start, then kind in the order of KINDS."""
    tested = "__secret_runs"
    while tested in docs.columns:
        tested += "_"  # a name that no column has
    worth = F.coalesce(docs[text].rlike(RUN), F.lit(False))
    # The battery's findings are read twice; they and their texts are written once.
    put = durable(docs.where(worth).select("*", battery(located(docs[text], RUN)).alias(tested)))
    bar = bar_of(put.select(F.col(tested).alias("tested")), level)
    rest = docs.where(~worth).withColumn(tested, F.lit(None).cast(put.schema[tested].dataType))
    docs = put.unionByName(rest)
    whole = F.coalesce(docs[text], F.lit(""))
    spans = []
    for nth, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        found = located(whole, pattern)
        if pattern == ASSIGN:
            found = F.filter(found, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
        elif pattern == ACCESS:
            found = F.filter(found, lambda s: F.length(s["match"]) >= 20)
        spans.append(_ranked(found, nth))
    found = discoveries(F.coalesce(docs[tested], F.array().cast(put.schema[tested].dataType)), bar["__secret_bar"], doubt)
    ordered = F.array_sort(F.concat(*spans, _ranked(found, 3)))
    named = F.transform(
        ordered,
        lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["nth"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    # One row of one number.
    return docs.join(F.broadcast(bar)).select(*[docs[c] for c in docs.columns if c not in (into, tested)], named.alias(into))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every reported span of the text replaced by ``mark``;
    spans that overlap or touch make one mark."""
    spans = "__secret_spans"
    while spans in docs.columns:
        spans += "_"  # a name that no column has
    found = scan(docs, text, into=spans)
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] <= F.get(a, F.size(a) - 1)["end"]),
            F.array_append(
                F.slice(a, F.lit(1), F.size(a) - 1),
                F.struct(
                    F.get(a, F.size(a) - 1)["start"].alias("start"),
                    F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end"),
                ),
            ),
        ).otherwise(F.array_append(a, F.struct(s["start"].alias("start"), s["end"].alias("end")))),
    )
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    starts = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    clean = F.when(F.size(spans) > 0, F.array_join(pieces, mark)).otherwise(F.col(text))
    return found.withColumn(text, clean).select(*docs.columns)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(joined(F.transform(base, written)), 256).alias("base_sha256"),
        joined(F.transform("spans", written)).alias("spans"),
        count("random"),
    )
