"""Quality rules as learned decision lists, in DataFrame functions only.

Sequential covering: conjunctions of thresholds over text statistics are grown on two thirds of the labelled
rows and pruned on the rest, each in aggregate queries; the list comes out as one ordered CASE expression.
Null and empty texts have zero words, so they fail the base rule. Repeated rows are judged one by one. A doc_id
with several labels counts with its lowest quality. Without labels of both kinds the list is empty and the base
rule alone decides. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.sampling import bounded_sample
from pairloom.sources.tables import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Statistics that a rule may test, each a share or a mean so that thresholds hold at any length. (The share of distinct words would fall
#: with the length of clean texts.)
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "digit_share", "adjacent_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def text(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class Rule:
    """Documents for which all conditions hold are rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def text(self) -> str:
        return " and ".join(c.text() for c in self.conditions)


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and maybe more) with the base counts and the statistics of FEATURES."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("text_", text).withColumn("words_", F.array_remove(F.split("text_", SPACE), ""))
    d = d.withColumn("n_words", F.size("words_").cast("long"))
    # Each array that a lambda looks into is bound as w, s or g: wherever the optimizer writes these columns out again, say in
    # a filter on them, an array is still made once a row and not once for each of its elements.
    d = d.withColumn(
        "starts_",
        F.expr(
            "transform(array(words_), w -> CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)) "
            "ELSE cast(array() AS array<struct<h:bigint,i:int>>) END)[0]"
        ),
    )
    d = d.withColumn("again_", F.expr("transform(array(sort_array(starts_)), s -> sort_array(transform(filter(s, (x, k) -> x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h), x -> x.i)))[0]"))
    d = d.withColumn("n_repeat_words", F.expr("transform(array(again_), g -> aggregate(transform(g, (x, k) -> least(3, coalesce(get(g, k + 1) - x, 3))), 0L, (a, b) -> a + b))[0]"))
    d = d.withColumn("lines_", F.expr(r"filter(split(text_, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    count = lambda pattern: F.length("text_") - F.length(F.regexp_replace("text_", pattern, ""))
    d = d.withColumns(
        {
            "word_chars": F.length(F.regexp_replace("text_", SPACE, "")).cast("long"),
            "n_symbols": (F.length("text_") - F.length(F.translate("text_", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "n_lines_": F.size("lines_"),
            "n_adjacent_": F.expr("transform(array(words_), w -> size(filter(w, (x, i) -> x = get(w, i - 1))))[0]"),
            "n_upper_": count(r"\p{Lu}+"),
            "n_exclaim_": count("!+"),
            "n_digit_": count("[0-9]+"),
        }
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return d.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines_"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "upper_share": share("n_upper_", "word_chars"),
            "exclaim_share": share("n_exclaim_", "word_chars"),
            "digit_share": share("n_digit_", "word_chars"),
            "adjacent_share": share("n_adjacent_", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents (doc_id, bad, FEATURES), chosen by a hash of doc_id."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(one, "doc_id", max_rows).select("doc_id", (F.col("quality") == 0).alias("bad"))
    # max_rows bounds the broadcast side
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return base_statistics(sample).select("doc_id", "bad", *FEATURES)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of narrowing a rule from p0 and n0 to p and n."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else 0.0


def learn(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.9, least_cover: int = 5) -> list[Rule]:
    """The ordered rules for rejecting, from a bounded sample of labelled rows (max_rows)."""
    sample = written(labelled_sample(docs, labels, max_rows).withColumn("prune", F.abs(F.hash("doc_id")) % 3 == 0), "rules-sample")
    quantiles = [i / bins for i in range(1, bins)]
    cuts = sample.agg(*(F.percentile(f, F.array(*map(F.lit, quantiles))).alias(f) for f in FEATURES)).first()
    tests = [(f, t) for f in FEATURES for t in sorted(set(cuts[f] or ()))]
    rules: list[Rule] = []
    left = sample
    for _ in range(max_rules):
        conditions: list[Condition] = []
        inside = left.where("not prune")
        while len(conditions) < max_conditions:
            holds = F.array(*(F.struct(F.lit(i).alias("i"), (F.col(f) > t).alias("above")) for i, (f, t) in enumerate(tests))) if tests else None
            if holds is None:
                break
            p0, n0 = inside.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
            if not p0 or not n0 and conditions:
                break
            counted = inside.select("bad", F.explode(holds).alias("t")).groupBy("t.i", "t.above").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()  # two rows a test
            best = max(((_gain(r.p, r.n, p0, n0), -r.i, r.above) for r in counted), default=(0.0, 0, False))
            if best[0] <= 1e-6:
                break
            feature, threshold = tests[-best[1]]
            conditions.append(Condition(feature, best[2], threshold))
            inside = inside.where(conditions[-1].column())
        if not conditions:
            break
        held = left.where("prune")
        prefixes = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        row = held.agg(*(F.count_if(c) for r in prefixes for c in (r.column() & F.col("bad"), r.column() & ~F.col("bad")))).first()
        scored = [((row[2 * k] - row[2 * k + 1]) / (row[2 * k] + row[2 * k + 1] or 1), -k) for k in range(len(prefixes))]
        k = -max(scored)[1]
        p, n = row[2 * k], row[2 * k + 1]
        if p < least_cover or p < least_precision * (p + n):
            break
        rules.append(prefixes[k])
        left = left.where(~prefixes[k].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false for rejected documents."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with its base counts, statistics, base_failed and kept."""
    return base_statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that base rule and list keep, in their own columns.

    The optimizer moves no filter below a row number, and so doesn't work the statistics out twice.
    """
    judged = judge(docs.select(F.struct("*").alias("row_"), "doc_id", "text"), rules).withColumn("at_", F.monotonically_increasing_id())
    return judged.where("kept and at_ >= 0").select("row_.*")
