"""Quality rules: a learned decision list over per-document text statistics.

Sequential covering on labelled documents: a rule is a conjunction of thresholds, grown condition by condition on two
thirds of the sample by information gain, then pruned on the last third, and kept if it is precise there and overall.  A
rule that is not bars its first condition, and the search goes on.  What a rule covers leaves the sample before the next
one is grown.  Spark counts every candidate threshold of a step in one small aggregation; only those counts (features x
bins) reach the driver.  The list becomes one ordered CASE expression.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; labels without a document, or
with a null, are not learned from, and of repeated labels the worse counts; null and repeated ids and repeated rows are
judged row by row; ties between conditions go to the first feature and threshold; without labels of both kinds, or with
fewer than MIN_COVER bad documents that the base rule lets pass, the list is empty and the base rule alone decides; a
very long text is handled in its row, in n log n; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, split_words, table

#: Labelled documents the rules are learned from, about and at most; all are used if there are fewer.
SAMPLE_ROWS = 20_000
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
#: Unfit first conditions after which the search ends.
MAX_BARRED = 4
#: Bad documents a condition and a rule cover, at least.
MIN_COVER = 3
WINDOW = 8
FEATURES = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "bang_rate", "word_length", "n_words")


def text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` as struct ``_keep``, and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_upper, n_bang, n_lines.

    Windows of eight words are compared by a 64-bit hash within their document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep")  # in one column no name of the caller's can clash
    words = docs.select(kept, text.alias("_text"), split_words(F.col("text")).alias("_words"))
    hashed = words.select(
        "_keep",
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.when(F.size("_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_hash"),
        F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"),
    )
    span = 1
    while span < WINDOW:  # a hash of 2, 4, then 8 words; the last places reach beyond the text and are cut off below
        ahead = F.slice("_hash", span + 1, F.size("_hash"))
        hashed = hashed.withColumn("_hash", F.zip_with("_hash", ahead, lambda a, b: F.xxhash64(a, b)))
        span *= 2
    hashed = hashed.withColumn("_hash", F.slice("_hash", 1, F.size("_hash") - WINDOW + 1))
    repeats = F.size(F.array_distinct("_hash")) < F.size("_hash")
    sorted_ = hashed.withColumn(
        "_sorted",
        F.when(repeats, F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))),
    )
    # neighbours of equal hash in the sorted list are places of a window that occurs twice or more
    placed = sorted_.withColumn(
        "_places",
        F.sort_array(
            F.array_distinct(
                F.flatten(
                    F.filter(
                        F.zip_with(
                            F.slice("_sorted", 1, F.size("_sorted") - 1),
                            F.slice("_sorted", 2, F.size("_sorted") - 1),
                            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
                        ),
                        lambda pair: pair.isNotNull(),
                    )
                )
            )
        ),
    )
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    without = lambda pattern: F.char_length("_text") - F.char_length(F.regexp_replace("_text", pattern, ""))
    counts = F.struct(
        "n_words",
        "word_chars",
        without("[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        without("[A-Z]+").cast("long").alias("n_upper"),
        without("!").cast("long").alias("n_bang"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    # one row in, one row out; a filter on the counts stays above, where they are computed, and is not copied into them
    return placed.select("_keep", F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.withColumns(
        {
            "symbol_rate": F.col("n_symbols") / chars,
            "repeat_rate": F.col("n_repeat_words") / words,
            "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "upper_rate": F.col("n_upper") / chars,
            "bang_rate": F.col("n_bang") / words,
            "word_length": F.col("word_chars") / words,
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        met = F.lit(True)
        for c in self.conditions:
            met = met & c.column()
        return met


def _conjunction(conditions) -> Column:
    return Rule(tuple(conditions), 0.0, 0).column()


def _gain(bad: int, good: int, before_bad: int, before_good: int) -> float:
    """FOIL's gain of narrowing (before_bad, before_good) to (bad, good)."""
    if bad == 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(before_bad / (before_bad + before_good)))


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list for bad documents (``quality`` 0), at most MAX_RULES rules, most useful first."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    if not total:
        return []
    # ids by hash, in expectation nine tenths of the bound; the sample of ids is what is broadcast, never more than the bound
    share = min(1.0, 0.9 * sample_rows / total)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + (share == 1.0))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    stats = materialize(text_stats(found, ("doc_id", "quality")), "quality-stats")
    sample = with_features(stats).where(~base_failed()).select(
        (F.col("_keep.quality") == 0).cast("int").alias("bad"),
        (F.pmod(F.xxhash64("_keep.doc_id", F.lit("fold")), F.lit(3)) == 0).alias("prune"),
        *[F.col(f).cast("double").alias(f) for f in FEATURES],
    )
    sample = materialize(sample, "quality-sample")
    # thresholds are quantiles of either kind, so that a small share of bad documents has its own
    steps = [i / BINS for i in range(BINS)] + [0.99]
    cuts = sample.groupBy("bad").agg(*[F.percentile_approx(f, steps, 2000).alias(f) for f in FEATURES]).collect()
    grid = {f: sorted({float(x) for row in cuts for x in row[f] if x is not None}) for f in FEATURES}
    if len(cuts) < 2:
        return []

    def bin_of(feature: str) -> Column:
        """How many of the feature's thresholds the value reaches."""
        return F.size(F.filter(F.array(*[F.lit(t) for t in grid[feature]]), lambda t: t <= F.col(feature)))

    bins = F.array(*[F.struct(F.lit(k).alias("f"), bin_of(f).alias("b")) for k, f in enumerate(FEATURES)])
    binned = materialize(sample.withColumn("bins", bins), "quality-bins")

    def counts(where: Column) -> list[tuple[int, int, int, int]]:
        rows = (
            binned.where(where & ~F.col("prune"))
            .select("bad", F.explode("bins").alias("x"))
            .groupBy("x.f", "x.b")
            .agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
        )
        return [(r["f"], r["b"], r["bad"], r["good"]) for r in rows.collect()]

    def grow(rest: Column, barred: set[tuple[str, bool]]) -> list[Condition]:
        """Conditions one by one, each of the best gain; the first is on none of the ``barred`` features and sides."""
        grown: list[Condition] = []
        for _ in range(MAX_CONDITIONS):
            table_ = counts(rest & _conjunction(grown))
            first = [x for x in table_ if x[0] == 0]
            bad, good = sum(x[2] for x in first), sum(x[3] for x in first)
            if not bad or not good:
                break
            best, step = 0.0, None
            for k, f in enumerate(FEATURES):
                own = [x for x in table_ if x[0] == k]
                for i, threshold in enumerate(grid[f]):
                    b, g = sum(x[2] for x in own if x[1] > i), sum(x[3] for x in own if x[1] > i)
                    for side, (p, q) in ((True, (b, g)), (False, (bad - b, good - g))):
                        if p >= MIN_COVER and (grown or (f, side) not in barred) and (v := _gain(p, q, bad, good)) > best:
                            best, step = v, Condition(f, side, threshold)
            if step is None or step in grown:
                break
            grown.append(step)
        return grown

    rules: list[Rule] = []
    rest, barred = F.lit(True), set()
    while len(rules) < MAX_RULES and len(barred) < MAX_BARRED:
        grown = grow(rest, barred)
        if not grown:
            break
        # prune: the prefix that does best on rows it was not grown on; all rows have to bear it out
        tally = [
            F.sum(F.when(_conjunction(grown[: i + 1]) & where, x)).alias(f"{fold}_{kind}{i}")
            for i in range(len(grown))
            for fold, where in (("held", F.col("prune")), ("all", F.lit(True)))
            for kind, x in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))
        ]
        got = sample.where(rest).agg(*tally).first()
        n = lambda name: got[name] or 0
        value = lambda i: (n(f"held_bad{i}") - n(f"held_good{i}")) / (n(f"held_bad{i}") + n(f"held_good{i}") + 1)
        i = max(range(len(grown)), key=lambda k: (value(k), -k))
        b, g = n(f"all_bad{i}"), n(f"all_good{i}")
        held = (n(f"held_bad{i}") + 0.5) / (n(f"held_bad{i}") + n(f"held_good{i}") + 1)
        precision = (b + 0.5) / (b + g + 1)
        if min(precision, held) < MIN_PRECISION or b < MIN_COVER:
            barred.add((grown[0].feature, grown[0].at_least))  # look on without it
            continue
        rules.append(Rule(tuple(grown[: i + 1]), precision, b))
        rest = rest & ~rules[-1].column()
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(number of the first rule that fires, or null; whether the document is kept) as ordered CASE expressions."""
    fired, bad = F.when(base_failed(), F.lit(0)), F.when(base_failed(), F.lit(False))
    for k, rule in enumerate(rules, 1):
        fired, bad = fired.when(rule.column(), F.lit(k)), bad.when(rule.column(), F.lit(False))
    return fired.cast("int"), bad.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",), bare: bool = False) -> DataFrame:
    """``keep`` (none named like a column here), the statistics, base_failed, kept and rule (0: the base rule).

    With ``bare`` the columns ``keep``, of whatever names, stay in the struct ``_keep``.
    """
    fired, kept = verdict(rules)
    return with_features(text_stats(docs, keep)).select(
        *(["_keep"] if bare else [F.col("_keep")[c].alias(c) for c in keep]),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        base_failed().alias("base_failed"),
        kept.alias("kept"),
        fired.alias("rule"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, learn_rules(docs, table(spark, sf_dir, "labels")))
