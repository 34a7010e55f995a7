"""Quality rules as a learned decision list (operator 4).

``statistics`` counts words, symbols, repeated lines and repeated windows of whole texts with
SQL functions only. ``learn`` grows conjunctions of thresholds on ratios of these counts by
sequential covering: a conjunction is grown on two thirds of the labelled rows by the FOIL
gain, cut back on the last third, and kept while it is precise; the rows it covers then leave
and the next is grown. The result is an ordered list that ``verdict`` turns into one chained
conditional expression, so that applying it is a narrow projection.

The labelled rows are at most ``sample`` (documented bound); every step of the search is one
aggregation of counts by feature and bin, a few hundred rows at most.

Defined cases: a null or empty text has no words and fails the base rules; without labels
there are no rules and the base rules decide alone; a document of any length is read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import WORD, free_name, named, own_columns
from fleetlens.llm.labels import labelled_sample
from fleetlens.session import checkpointed

WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED = 50
SAMPLE = 20_000
BINS = 32
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_PRECISION = 0.95
MIN_COVER = 3
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits"]


def _repeated(windows: Column) -> Column:
    """Words that lie in windows found twice or more, from the hash of each window in order."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def with_order(rows: Column) -> Column:
        twins = F.filter(
            rows,
            lambda r, k: (F.get(rows, k - 1)["h"] == r["h"]) | (F.get(rows, k + 1)["h"] == r["h"]),
        )
        places = F.sort_array(F.transform(twins, lambda r: r["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places, start,
            lambda seen, p: F.struct(
                (p + WINDOW).alias("end"), (seen["n"] + p + WINDOW - F.greatest(seen["end"], p)).alias("n")
            ),
            lambda seen: seen["n"],
        )

    counted = F.transform(F.array(ordered), with_order)[0]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), counted).otherwise(F.lit(0))


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the counts of each text, and where they are by name.

    The counts are generated, as a filter on them would be pushed below a plain projection
    and count all over again.
    """
    names = {n: free_name(docs, n) for n in [*COUNTS, "words", "lines", "windows", "whole"]}
    col = {n: named(c) for n, c in names.items()}

    def kept_chars(pattern: str) -> Column:
        return F.length(F.regexp_replace(col["whole"], pattern, ""))

    words = F.regexp_extract_all(col["whole"], F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(col["whole"], "\n"), lambda line: line.rlike(WORD))
    windows = F.when(
        F.size(col["words"]) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(col["words"]) - WINDOW),
            lambda i: F.xxhash64(*[F.get(col["words"], i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counts = {
        "n_words": F.size(col["words"]),
        "word_chars": kept_chars(r"[\x20\x09-\x0D]+"),
        "n_symbols": kept_chars(r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size(col["lines"]) - F.size(F.array_distinct(col["lines"])),
        "n_repeat_words": _repeated(col["windows"]),
        "n_lines": F.size(col["lines"]),
        "n_distinct_words": F.size(F.array_distinct(col["words"])),
        "n_upper": kept_chars(r"[^A-Z]+"),
        "n_marks": kept_chars(r"[^!?]+"),
        "n_digits": kept_chars(r"[^0-9]+"),
    }
    staged = (
        docs.withColumn(names["whole"], F.coalesce(named(text), F.lit("")))
        .withColumns({names["words"]: words, names["lines"]: lines})
        .withColumn(names["windows"], windows)
    )
    row = F.struct(*[c.cast("bigint").alias(names[n]) for n, c in counts.items()])
    counted = staged.select(*own_columns(docs), F.inline_outer(F.array(row)))
    return counted, {n: col[n] for n in COUNTS}


def base_failed(col: dict[str, Column]) -> Column:
    return (col["n_words"] < MIN_WORDS) | (100 * col["n_repeat_words"] > MAX_REPEATED * col["n_words"])


def features(col: dict[str, Column]) -> dict[str, Column]:
    """Ratios that rules may test; 0 where there is nothing to divide by."""

    def ratio(a: str, b: str) -> Column:
        return F.when(col[b] > 0, col[a] / col[b]).otherwise(0.0)

    return {
        "words": col["n_words"].cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbols": ratio("n_symbols", "word_chars"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeated": ratio("n_repeat_words", "n_words"),
        "line_words": ratio("n_words", "n_lines"),
        "distinct": ratio("n_distinct_words", "n_words"),
        "upper": ratio("n_upper", "word_chars"),
        "marks": ratio("n_marks", "n_words"),
        "digits": ratio("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions hold."""

    conditions: tuple[Condition, ...]

    def holds(self, values: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, [c.holds(values) for c in self.conditions])


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does and the document is kept."""
    chain = None
    for i, rule in enumerate(rules, 1):
        chain = F.when(rule.holds(values), F.lit(i)) if chain is None else chain.when(rule.holds(values), F.lit(i))
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def _counts(rows: DataFrame, names: list[str]) -> dict[tuple[int, int], tuple[int, int]]:
    """{(feature, bin): (rejected, kept)}: one aggregation, its result bounded by features x bins."""
    bins = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"bin_{n}").alias("bin")) for i, n in enumerate(names)])
    counted = (
        rows.select("reject", F.inline(bins))
        .groupBy("feature", "bin")
        .agg(F.count_if("reject").alias("p"), F.count_if(~F.col("reject")).alias("n"))
    )
    return {(r["feature"], r["bin"]): (r["p"], r["n"]) for r in counted.collect()}


def _best(counts: dict, names: list[str], thresholds: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition] | None:
    """The threshold with the highest FOIL gain; ties go to the earlier feature and lower threshold."""
    best = None
    for i, name in enumerate(names):
        below_p = below_n = 0
        for k, threshold in enumerate(thresholds[name]):
            p, n = counts.get((i, k), (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for at_least, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                if p >= MIN_COVER:
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, Condition(name, at_least, threshold)
    return best


def _tally(rows: DataFrame, tests: list[Column]) -> list[tuple[int, int]]:
    """(rejected, kept) rows for which each test holds, in one job."""
    counted = rows.agg(
        *[F.count_if(t & F.col("reject")).alias(f"p{i}") for i, t in enumerate(tests)],
        *[F.count_if(t & ~F.col("reject")).alias(f"n{i}") for i, t in enumerate(tests)],
    ).first()
    return [(counted[f"p{i}"], counted[f"n{i}"]) for i in range(len(tests))]


def learn_from(rows: DataFrame, names: list[str]) -> list[Rule]:
    """Rules from rows (reject boolean, grow boolean, one double per feature)."""
    quantiles = rows.agg(
        *[F.percentile_approx(n, [k / BINS for k in range(1, BINS)], 1000).alias(n) for n in names]
    ).first()
    thresholds = {n: sorted(set(quantiles[n] or [])) for n in names}
    values = {n: F.col(n) for n in names}
    for n in names:
        steps = [(F.col(n) >= t).cast("int") for t in thresholds[n]]
        rows = rows.withColumn(f"bin_{n}", reduce(lambda a, b: a + b, steps) if steps else F.lit(0))
    rows = checkpointed(rows.coalesce(4))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rows.filter(verdict(rules, values) == 0)
        grow = left.filter("grow")
        conditions: list[Condition] = []
        reached = grow
        while len(conditions) < MAX_CONDITIONS:
            counts = _counts(reached, names)
            p0 = sum(p for (f, _), (p, _) in counts.items() if f == 0)
            n0 = sum(n for (f, _), (_, n) in counts.items() if f == 0)
            if p0 < MIN_COVER or (conditions and n0 == 0):
                break
            found = _best(counts, names, thresholds, p0, n0)
            if found is None:
                break
            conditions.append(found[1])
            reached = reached.filter(found[1].holds(values))
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        worth = [
            ((p - n) / (p + n) if p + n else -1.0) for p, n in _tally(left.filter("not grow"), [r.holds(values) for r in prefixes])
        ]
        rule = prefixes[max(range(len(prefixes)), key=lambda k: (worth[k], -k))]
        ((p, n),) = _tally(left, [rule.holds(values)])
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules that reject what ``labels.quality`` marks 0, from documents that pass the base rules."""
    chosen = labelled_sample(docs, labels, "quality", sample, doc_id, text)
    counted, col = with_statistics(chosen)
    values = features(col)
    rows = counted.filter(~base_failed(col)).select(
        (F.col("label") == 0).alias("reject"),
        (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("grow")), F.lit(3)) > 0).alias("grow"),
        *[c.alias(n) for n, c in values.items()],
    )
    return learn_from(checkpointed(rows), list(values))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the counts, base_failed, rule (0: none) and kept, and where they are by name."""
    counted, col = with_statistics(docs, text)
    names = {n: free_name(counted, n) for n in ("base_failed", "rule", "kept")}
    judged = counted.withColumns(
        {names["base_failed"]: base_failed(col), names["rule"]: verdict(rules, features(col))}
    ).withColumn(names["kept"], ~named(names["base_failed"]) & (named(names["rule"]) == 0))
    return judged, col | {n: named(c) for n, c in names.items()}


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns. Nothing moves."""
    judged, col = judge(docs, rules, text)
    return judged.filter(col["kept"]).select(*own_columns(docs))
