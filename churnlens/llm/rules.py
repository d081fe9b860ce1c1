"""Quality rules as a learned decision list (operator 10), with DataFrame functions only.

Statistics of each whole text are array and string expressions on its row: no
row is exploded and nothing is shuffled. From the labelled statistics, sequential covering
learns rules that reject: a rule grows by the threshold condition with the best information
gain on the growing rows, until it covers no good text; it is pruned to the prefix that does
best on the pruning rows; the rows it covers are set aside, and the next rule is learned on the
rest. Each step needs only the histogram (statistic, threshold bin, label) of the rows in
question, one aggregation whose result has at most len(STATS) * (2 * CUTS + 1) * 2 rows; it
covers every labelled row outside the held-out fifth, without a sample. The list is
emitted as one ordered conditional expression.

Rows: null text has no words; a null doc_id is kept and has the remainder of an empty text;
repeated rows are judged alike; labels that are null or of unknown documents are not used;
without labels there are no rules, and the base decides; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import common

STATS = ("n_words", "word_length", "symbols", "exclaims", "upper", "digits", "dup_lines", "repeated", "different", "lines",
         "stops", "bars")
CUTS = 24
MAX_RULES = 16
MAX_CONDITIONS = 4
WINDOW = 5


def _repeat_words(at: Column) -> Column:
    """Words in windows that stand twice or more; ``at``: (hash, place) of each window, sorted. It must be a
    column of its own: an expression would be worked out anew for each element."""
    def twice(p: Column, k: Column) -> Column:
        return F.coalesce(F.get(at, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(
            F.get(at, k + 1)["h"] == p["h"], F.lit(False))
    starts = F.sort_array(F.filter(F.transform(at, lambda p, k: F.when(twice(p, k), p["i"])), lambda i: i.isNotNull()))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, first, lambda a, i: F.struct(
        i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each whole text."""
    text = common.whole_text()
    df = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id"), common.words_of(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(common.WORD)).alias("l"),
        # the characters that some statistic counts
        F.regexp_replace(text, r"[^#*$%&|<>!A-Z0-9.?]+", "").alias("c"),
        F.length(F.regexp_replace(text, r"[\x00-@\[-`{-\x7f]+", "")).alias("letters"))
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(
        *[F.get(F.col("h"), i + k) for k in range(WINDOW)]))
    df = df.withColumn("g", F.when(F.size("w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    sorted_windows = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("at", F.when(F.size(F.array_distinct("g")) < F.size("g"), sorted_windows))

    def kept(chars: str) -> Column:
        return F.length(F.regexp_replace("c", f"[^{chars}]+", "")).cast("bigint")
    n = F.size("w").cast("bigint")
    return df.select(
        "_row", "doc_id", n.alias("n_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
        kept("#*$%&|<>").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("at").isNull(), 0).otherwise(_repeat_words(F.col("at"))).cast("bigint").alias("n_repeat_words"),
        F.size(F.array_distinct("h")).cast("bigint").alias("n_different"), F.size("l").cast("bigint").alias("n_lines"),
        kept("!").alias("n_exclaims"), kept("A-Z").alias("n_upper"), kept("0-9").alias("n_digits"),
        kept(".?").alias("n_stops"), kept("|").alias("n_bars"), F.col("letters").cast("bigint").alias("n_letters"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_stats(counts: DataFrame) -> DataFrame:
    """Add the statistics that rules test, as ``s_<name>``."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    chars = F.greatest("word_chars", F.lit(1)).cast("double")
    values = {
        "n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n,
        "exclaims": F.col("n_exclaims") / n, "upper": F.col("n_upper") / F.greatest("n_letters", F.lit(1)),
        "digits": F.col("n_digits") / chars, "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated": F.col("n_repeat_words") / n, "different": F.col("n_different") / n, "lines": F.col("n_lines") / n,
        "stops": F.col("n_stops") / n, "bars": F.col("n_bars") / n}
    return counts.withColumns({f"s_{name}": values[name] for name in STATS})


@dataclass(frozen=True)
class Condition:
    """statistic >= cut, or < cut."""

    stat: str
    least: bool
    cut: float

    def column(self) -> Column:
        x = F.col(f"s_{self.stat}")
        return x >= self.cut if self.least else x < self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.least else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Thresholds of each statistic: quantiles of the good and of the poor texts."""
    at = [i / CUTS for i in range(CUTS + 1)]
    every = rows.groupBy("quality").agg(*[F.percentile_approx(f"s_{s}", at, 2000).alias(s) for s in STATS]).collect()
    out = {}
    for s in STATS:
        values = sorted({v for r in every for v in r[s]})
        # half-way points: a threshold shall not depend on which of two neighbours was drawn
        out[s] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return out


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """For each statistic and bin: [good, poor] rows."""
    each = rows.select("quality", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(f"b_{s}").alias("bin")) for s in STATS])).alias("x"))
    out = {s: [[0, 0] for _ in range(len(cuts[s]) + 1)] for s in STATS}
    for r in each.groupBy("x.stat", "x.bin", "quality").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["stat"]][r["bin"]][1 - r["quality"]] += r["n"]
    return out


def _best(histogram: dict, cuts: dict) -> tuple[Condition, int, int, float] | None:
    """The condition with the best gain: (condition, poor covered, good covered, gain)."""
    best = None
    for s in STATS:
        good, poor = (sum(b[i] for b in histogram[s]) for i in (0, 1))
        if not poor:
            return None
        before = math.log2(poor / (poor + good))
        g = p = 0
        for b, cut in zip(histogram[s], cuts[s], strict=False):
            g, p = g + b[0], p + b[1]
            for least, pp, gg in ((False, p, g), (True, poor - p, good - g)):
                if pp:
                    gain = pp * (math.log2(pp / (pp + gg)) - before)
                    if best is None or gain > best[3] + 1e-9:
                        best = (Condition(s, least, cut), pp, gg, gain)
    return best


def learn(labelled: DataFrame, least_precision: float = 0.9, least_share: float = 0.002) -> list[Rule]:
    """Ordered rules that reject. ``labelled``: doc_id, quality and statistics."""
    cuts = _cuts(labelled)
    if not any(cuts.values()):
        return []
    bins = {f"b_{s}": _bin(s, cuts[s]) for s in STATS}
    rows = common.stored(labelled.withColumns(bins | {"grow": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) != 0}), "rule-rows")
    n_poor = rows.where("quality = 0").count()
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        growing = left.where("grow")
        while len(rule) < MAX_CONDITIONS:
            found = _best(_histogram(growing.where(matches(rule)), cuts), cuts)
            if found is None or found[3] <= 1e-6:
                break
            rule += (found[0],)
            if not found[2]:
                break
        if not rule:
            break
        prefixes = [rule[:i + 1] for i in range(len(rule))]
        seen = left.agg(*[F.count(F.when(matches(r) & (F.col("grow") == g) & (F.col("quality") == q), 1)).alias(f"n{i}_{int(g)}_{q}")
                          for i, r in enumerate(prefixes) for g in (False, True) for q in (0, 1)]).first()

        def worth(i: int, seen=seen) -> float:
            p, g = seen[f"n{i}_0_0"], seen[f"n{i}_0_1"]
            return (p - g) / (p + g) if p + g else -1.0
        i = max(range(len(rule)), key=lambda k: (worth(k), -k))
        poor, good = (seen[f"n{i}_0_{q}"] + seen[f"n{i}_1_{q}"] for q in (0, 1))
        if poor < least_precision * (poor + good) or poor < max(2, least_share * n_poor):
            break
        rules.append(prefixes[i])
        left = left.where(~matches(prefixes[i]))
    return rules


def _bin(stat: str, cuts: list[float]) -> Column:
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(points, lambda c: c <= F.col(f"s_{stat}")))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects, or null: the list as one conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(matches(rule), i + 1) if out is None else out.when(matches(rule), i + 1)
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(one row per document with counts, base_failed, rule and kept; the rules)."""
    counts = common.stored(text_counts(docs), "rule-counts").withColumn("base_failed", base_failed())
    rows = with_stats(counts)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    known = labels.where(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").alias("_d"), F.col("quality").cast("int").alias("quality"))
    labelled = rows.where(~held_out & ~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_d")).select(
        "doc_id", "quality", *[f"s_{s}" for s in STATS])
    rules = learn(common.stored(labelled, "rule-labelled"))
    judged = rows.withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged, _ = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "rule")
