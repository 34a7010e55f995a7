"""Mixing sources to target weights over a curriculum that varies with time (operator 1).

Each source has a weight schedule: knots (progress, weight) joined by straight lines over the
progress of training, 0 to 1. The area under it is the source's share of the mix, so targets
follow from the areas; a target stops at ``cap`` times the source's size and the excess is
shared again by weight. A source's documents, in the order of a hash of their ids, meet its
demand one after another and again from the start where it asks for more than one pass. A
document's place in the cumulative demand is turned into a position in training by inverting
the integral, which is a root of a quadratic within one stretch between knots.

Everything is DataFrame work. The running totals of a source are taken in two steps, over
hash ranges and then within one, so a source with any share of the rows is never one task.

Defined cases: a null text has size 0; a document of size 0 is never taken; null is a source
of its own and the last; rows that repeat an id are separate documents; an empty table gives
an empty mix. Columns added take further underscores where the input has their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.frames import WORD, free_name, named, own_columns

CAP = 3
WEIGHTS = (1, 2, 3)
#: Change of a source's weight from the start to the end of training, as a share of its mean.
DRIFT = (-0.5, 0.0, 0.5)
ADDED = ["size", "source_size", "target", "taken", "copies"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked_schedules(sources: DataFrame) -> DataFrame:
    """Schedules by rank of the source's name: means 1, 2, 3 repeating, falling, level or rising."""
    rank = F.dense_rank().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    drift = F.element_at(F.array(*[F.lit(d) for d in DRIFT]), ((rank / len(WEIGHTS)).cast("int") % len(DRIFT) + 1).cast("int"))
    knots = F.array(
        F.struct(F.lit(0.0).alias("at"), (weight * (1 - drift)).alias("weight")),
        F.struct(F.lit(1.0).alias("at"), (weight * (1 + drift)).alias("weight")),
    )
    return sources.withColumn("knots", knots)


def _stretches(knots: Column) -> Column:
    """Stretches between knots with the area before each: (start, width, weight, slope, before)."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["at"].alias("start"),
            (F.element_at(knots, i + 1)["at"] - F.element_at(knots, i)["at"]).alias("width"),
            F.element_at(knots, i)["weight"].alias("weight"),
            (F.element_at(knots, i + 1)["weight"] - F.element_at(knots, i)["weight"]).alias("rise"),
        ),
    )

    def area(s: Column) -> Column:
        return s["width"] * (s["weight"] + s["rise"] / 2)

    return F.transform(
        pairs,
        lambda s, i: F.struct(
            s["start"].alias("start"), s["width"].alias("width"), s["weight"].alias("weight"), s["rise"].alias("rise"),
            F.aggregate(F.slice(pairs, F.lit(1), i), F.lit(0.0), lambda total, p: total + area(p)).alias("before"),
            area(s).alias("area"),
        ),
    )


def source_targets(sizes: DataFrame, schedules, cap: int = CAP) -> DataFrame:
    """Add ``target`` and ``stretches`` to (source, key, source_size), one row per source.

    Sources are put in the order in which they would reach their cap as the common factor of
    all weights grows. The first that is not capped at the factor left for it and all after
    it settles that factor, which is what sharing the excess again and again comes to.
    """
    filled = Window.orderBy(F.col("_ratio"), F.col("key"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    limit = (F.col("source_size") * cap).cast("double")
    share = F.aggregate("stretches", F.lit(0.0), lambda total, s: total + s["area"])
    factor = (
        F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    ) / F.sum("_share").over(after)
    return (
        schedules(sizes)
        .withColumn("stretches", _stretches(F.col("knots")))
        .withColumns({"_limit": limit, "_share": share})
        .withColumn("_ratio", F.when(F.col("_share") > 0, F.col("_limit") / F.col("_share")).otherwise(float("inf")))
        .withColumn("_factor", factor)
        .withColumn("_level", F.min(F.when(F.col("_factor") <= F.col("_ratio"), F.struct("_ratio", "key", "_factor"))).over(every)["_factor"])
        .withColumn("target", F.least(F.col("_limit"), F.coalesce(F.col("_level") * F.col("_share"), F.col("_limit"))))
        .select("key", "source_size", "target", "stretches")
    )


def _position(stretches: Column, quota: Column) -> Column:
    """Progress at which the area under the schedule reaches ``quota`` (0 to 1) of the whole."""
    whole = F.element_at(stretches, -1)["before"] + F.element_at(stretches, -1)["area"]
    return F.transform(
        F.array(quota * whole),
        lambda asked: F.transform(
            F.slice(F.filter(stretches, lambda s: (s["before"] <= asked) & (s["area"] > 0)), -1, 1),
            lambda s: s["start"]
            + s["width"] * (2 * ((asked - s["before"]) / s["width"]))
            / (s["weight"] + F.sqrt(s["weight"] * s["weight"] + 2 * s["rise"] * ((asked - s["before"]) / s["width"]))),
        )[0],
    )[0]


def assign(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    schedules=ranked_schedules,
    cap: int = CAP,
    whole: bool = False,
    digits: int = 3,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken and copies: array of (copy, words, position).

    ``schedules`` adds ``knots`` to the table of sources. The last pass over a source ends
    within a document; ``whole`` takes that document if its middle is still asked for, else
    only the words asked for. ``digits`` hex digits of the id's hash make 16**digits ranges.
    """
    names = {n: free_name(docs, n) for n in [*ADDED, "key", "hash", "range", "start", "stretches"]}
    col = {n: named(c) for n, c in names.items()}
    keyed = docs.withColumns(
        {
            names["size"]: word_count(named(text)),
            names["key"]: F.coalesce(F.concat(F.lit("="), named(source).cast("string")), F.lit("")),
            names["hash"]: F.md5(F.coalesce(named(doc_id).cast("string"), F.lit(""))),
        }
    ).withColumn(names["range"], F.substring(col["hash"], 1, digits))
    narrow = keyed.select(
        col["key"].alias("key"), col["range"].alias("range"), col["size"].alias("size"), named(source).alias("source")
    )
    ranges = narrow.groupBy("key", "range").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    starts = ranges.select(
        F.col("key").alias("_key"), F.col("range").alias("_range"),
        (F.sum("size").over(Window.partitionBy("key").orderBy("range")) - F.col("size")).alias(names["start"]),
    )
    sizes = ranges.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, schedules, cap).select(
        F.col("key").alias("_target_key"), F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]), F.col("stretches").alias(names["stretches"]),
    )
    inner = Window.partitionBy(col["key"], col["range"]).orderBy(col["hash"], named(doc_id), col["size"])
    within = free_name(docs, "within")
    placed = (
        keyed.withColumn(within, F.sum(col["size"]).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - col["size"])
        .join(starts, (col["key"] == F.col("_key")) & (col["range"] == F.col("_range")))
        .join(targets, col["key"] == F.col("_target_key"))
    )
    before = col["start"] + named(within)
    asked = F.floor(col["target"])
    passes = F.when(col["source_size"] > 0, F.floor(asked / col["source_size"])).otherwise(F.lit(0)).cast("bigint")
    rest = asked - passes * col["source_size"]
    if whole:
        last = F.when(2 * before + col["size"] <= 2 * rest, col["size"]).otherwise(F.lit(0).cast("bigint"))
    else:
        last = F.greatest(F.lit(0).cast("bigint"), F.least(col["size"], rest - before))
    taken = passes * col["size"] + last

    def copy(i: Column) -> Column:
        words = F.when(i < passes, col["size"]).otherwise(last)
        middle = i * col["source_size"] + before + words / 2
        position = _position(col["stretches"], F.least(F.lit(1.0), middle / col["target"]))
        return F.struct(i.cast("int").alias("copy"), words.alias("words"), position.alias("position"))

    copies = F.when(
        taken > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), passes - F.when(last > 0, 0).otherwise(1)), copy)
    ).otherwise(F.array().cast("array<struct<copy:int,words:bigint,position:double>>"))
    return placed.withColumn(names["taken"], taken).withColumn(names["copies"], copies).select(
        *own_columns(docs), *[col[n] for n in ADDED]
    )


def mixture(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix in training order: a row of ``docs`` for every copy taken, then copy, words, position.

    Rows are dealt out and sorted by ranges of position.
    """
    names = {n: free_name(docs, n) for n in ["copy", "words", "position"]}
    plan = assign(docs, doc_id, **options)
    copies = plan.columns[-1]
    rows = plan.select(*own_columns(docs), F.explode(named(copies)).alias("_copy")).select(
        *own_columns(docs), *[F.col(f"_copy.{n}").alias(c) for n, c in names.items()]
    )
    order = [named(names["position"]), named(doc_id), named(names["copy"])]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
