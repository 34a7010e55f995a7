"""Routing, target health, object lifecycle, dead letters and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions.text import matches, wildcard
from fleetlens.session import checkpointed


#: Characters up to which the literal parts of a pattern are looked up: those at its ends, beyond that in steps, and those between.
AT_ENDS, END_STEP, BETWEEN = 64, 32, 16
#: Bits that tell the literal parts of a pattern apart, the first of them, and those that hold a part's length.
PART_BITS, LENGTH_BITS = 20, 10


def _literal_keys(pieces: Column) -> Column:
    """What a value that matches must have: the whole, or how it begins and ends and what is between the wildcards.

    ``pieces`` are those of the pattern between its wildcards.
    """

    def cut(piece: Column) -> Column:
        n = F.length(piece)
        return F.when(n > AT_ENDS, n - n % END_STEP).otherwise(n)

    first, last = F.get(pieces, F.lit(0)), F.element_at(pieces, -1)
    between = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), lambda piece: piece != "")
    key = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.length(text).alias("length"), text.alias("text"))
    begin = key("begin", F.substring(first, F.lit(1), cut(first)))
    end = key("end", F.substring(last, -cut(last), cut(last)))
    inner = F.transform(between, lambda piece: key("between", F.substring(piece, F.lit(1), F.lit(BETWEEN))))
    parts = F.slice(F.concat(F.array(begin, end), inner), 1, 1 << PART_BITS)
    return F.when(F.size(pieces) == 1, F.array(key("whole", first))).otherwise(parts)


def _keys_of(value: Column, kind: Column, length: Column) -> Column:
    """The texts under which a matching pattern may be filed, of one kind and length."""
    n = F.length(value)
    within = F.transform(F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))), lambda i: F.substring(value, i, length))
    return (
        F.when((kind == "whole") & (n == length), F.array(value))
        .when((kind == "whole") | (n < length), F.expr("cast(array() AS array<string>)"))
        .when(kind == "begin", F.array(F.substring(value, F.lit(1), length)))
        .when(kind == "end", F.array(F.substring(value, -length, length)))
        .otherwise(F.array_distinct(within))
    )


def _filed_rules(route_rules: DataFrame) -> DataFrame:
    """One rule per port and pattern, the first that counts, under the literal part of its pattern that the fewest rules have.

    Parts are counted by a hash; the rarest of a pattern is a number that holds how many have it,
    how short it is and its place, so that it is found without sorting. Where texts share a hash
    another part is taken, under which the rule is found as well. Spark's estimates know neither
    how many parts a pattern has nor how many rules a derived table has, so the counts are merged:
    a broadcast of them takes the driver's memory.
    """
    known = route_rules.filter("port IS NOT NULL AND pattern IS NOT NULL")
    pieces = F.split("pattern", r"[*?]").alias("_pieces")
    hashed = F.xxhash64("_key.kind", "_key.text").alias("_hash")
    often = (
        known.select("port", pieces).select("port", F.explode(_literal_keys(F.col("_pieces"))).alias("_key"))
        .select("port", hashed).groupBy("port", "_hash").agg(F.count("*").alias("_n"))
    )
    first = F.min(F.struct(F.col("priority").isNull().alias("none"), "priority", "target")).alias("_rule")
    best = known.groupBy("port", "pattern").agg(first).select("*", pieces)
    parts = best.select("port", "pattern", "_rule", F.posexplode(_literal_keys(F.col("_pieces"))).alias("_place", "_key"))
    rarity = (
        F.shiftleft(F.least("_n", F.lit(1 << 32)), PART_BITS + LENGTH_BITS)
        + F.shiftleft(F.greatest(F.lit((1 << LENGTH_BITS) - 1) - F.col("_length"), F.lit(0)).cast("bigint"), PART_BITS)
        + F.col("_place")
    )
    rarest = F.min(rarity).bitwiseAND((1 << PART_BITS) - 1).cast("int").alias("_place")
    filed = (
        parts.select("port", "pattern", "_rule", "_place", F.col("_key.length").alias("_length"), hashed)
        .join(often.hint("merge"), ["port", "_hash"]).groupBy("port", "pattern", "_rule").agg(rarest)
        .select("*", pieces).select("*", F.explode(F.array(F.get(_literal_keys(F.col("_pieces")), F.col("_place")))).alias("_key"))
    )
    return filed.select("port", "_key.*", "_rule", wildcard(F.col("pattern")).alias("_like"))


def route(requests: DataFrame, route_rules: DataFrame, default: str = rules.DEFAULT_TARGET) -> DataFrame:
    """Add ``target``: of the listener's rules whose path pattern matches, the lowest priority.

    A rule without a priority comes last, and of equal priorities the first target by name.
    Requests are reduced to distinct (port, path). A rule is filed under one literal part of
    its pattern, of those it has the one that the fewest rules share: how it begins or ends,
    what is between two wildcards, or the whole if it has none. A path looks up its beginnings,
    ends and parts of the lengths that occur, so it meets few rules however many there are,
    also where they share a folder. What paths look up is many times the paths, which Spark's
    estimate does not know, so it is merged with the rules: neither side is broadcast.
    """
    filed = _filed_rules(route_rules)
    levels = filed.groupBy().agg(F.array_sort(F.collect_set(F.struct("kind", "length")))).scalar()
    first = F.min("_rule")
    hits = (
        requests.filter("port IS NOT NULL AND path IS NOT NULL").select("port", "path").distinct()
        .select("port", "path", F.explode(levels).alias("_level"))
        .select("port", "path", F.col("_level.kind").alias("kind"), F.explode(_keys_of(F.col("path"), F.col("_level.kind"), F.col("_level.length"))).alias("text"))
        .join(filed.hint("merge"), ["port", "kind", "text"])
        .filter(matches(F.col("path"), F.col("_like")))
        .groupBy(F.col("port").alias("_port"), F.col("path").alias("_path"))
        .agg(first.alias("_hit"))
    )
    return requests.join(hits, (F.col("port") == F.col("_port")) & (F.col("path") == F.col("_path")), "left").select(
        *requests.columns, F.coalesce("_hit.target", F.lit(default)).alias("target")
    )


def health_states(
    probes: DataFrame,
    healthy_n: int = rules.HEALTHY_COUNT,
    unhealthy_n: int = rules.UNHEALTHY_COUNT,
    slices: int | None = None,
) -> DataFrame:
    """Add ``state`` to probes (target, ts, event_id, ok): it flips after enough equal results.

    The state is ``unknown`` until the first flip, and null for a probe without a target or a
    time, which has no place in an order. One target, or one busy hour of it, may hold any
    share of the probes, so probes are cut into ranges of (target, ts, event_id) of about
    equal size (``slices`` of them, or as many as the session's shuffle partitions), kept in
    the shared folder. A slice of a target is summed up in one row: its first run, its last
    run and the last flip it reaches by itself. Only these rows are ordered over a whole
    target, to carry the open run and the state into the next slice. Each probe then adds
    what was carried in to its own run.
    """
    order = ["target", "ts", "event_id"]
    placeable = F.col("target").isNotNull() & F.col("ts").isNotNull()
    placed = probes.filter(placeable)
    ranged = placed.repartitionByRange(slices, *order) if slices else placed.repartitionByRange(*order)
    ranged = checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))
    keys = ["target", "_slice"]
    by_time = Window.partitionBy(*keys).orderBy("ts", "event_id")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.coalesce(F.col("ok") != F.col("_before"), F.lit(False))

    def flip(ok: Column, length: Column) -> Column:
        return F.when(ok & (length >= healthy_n), "healthy").when(~ok & (length >= unhealthy_n), "unhealthy")

    runs = (
        ranged.withColumns({"_before": F.lag("ok").over(by_time), "_row": F.row_number().over(by_time)})
        .withColumn("_start", F.max(F.when(changed, F.col("_row"))).over(so_far))
        .withColumn("_length", F.col("_row") - F.coalesce("_start", F.lit(1)) + 1)
        .drop("_before")
    )
    leading = F.col("_start").isNull()
    own_flip = flip(F.col("ok"), F.col("_length"))
    summary = runs.groupBy(*keys).agg(
        F.max_by("ok", F.when(leading, F.col("_row"))).alias("first_ok"),
        F.max(F.when(leading, F.col("_length"))).alias("first_length"),
        F.max_by("ok", "_row").alias("last_ok"),
        F.max_by("_length", "_row").cast("bigint").alias("last_length"),
        F.max_by(own_flip == "healthy", F.when(own_flip.isNotNull(), F.col("_row"))).alias("own_healthy"),
        F.bool_and(leading).alias("uniform"),
    )
    slices = Window.partitionBy("target").orderBy("_slice")
    open_runs = (
        summary.withColumn("_new", ~F.col("uniform") | F.coalesce(F.col("first_ok") != F.lag("last_ok").over(slices), F.lit(True)))
        .withColumn("_island", F.count_if("_new").over(slices))
        .withColumn("_open", F.sum("last_length").over(Window.partitionBy("target", "_island").orderBy("_slice")))
        .withColumns({"_in_ok": F.lag("last_ok").over(slices), "_in_length": F.lag("_open").over(slices)})
    )

    def carried(ok: Column) -> Column:
        return F.when(ok == F.col("_in_ok"), F.col("_in_length")).otherwise(0)

    own = F.when(F.col("own_healthy"), "healthy").when(~F.col("own_healthy"), "unhealthy")
    first = flip(F.col("first_ok"), F.col("first_length") + carried(F.col("first_ok")))
    carry_in = open_runs.withColumn("_out", F.coalesce(own, first)).select(
        *keys,
        "_in_ok",
        "_in_length",
        F.last("_out", True).over(slices.rowsBetween(Window.unboundedPreceding, -1)).alias("_in_state"),
    )
    length = F.col("_length") + F.when(leading, carried(F.col("ok"))).otherwise(0)
    states = (
        runs.join(carry_in, keys)
        .withColumn("_state", F.last(flip(F.col("ok"), length), True).over(so_far))
        .select(*probes.columns, F.coalesce("_state", "_in_state", F.lit("unknown")).alias("state"))
    )
    return states.unionByName(probes.filter(~placeable).withColumn("state", F.lit(None).cast("string")))


def lifecycle(objects: DataFrame, stage_rules: DataFrame, as_of: str) -> DataFrame:
    """Add ``stage`` to objects (class, created): the highest threshold reached on ``as_of``.

    An object created later is ``not_yet`` there, and one without a date has no stage.
    The thresholds of a class become intervals that do not overlap, so an object meets one
    rule at most: an equi-join on the class that never multiplies or regroups objects.
    """
    day = F.lit(as_of).cast("date")
    by_class = Window.partitionBy("class").orderBy("days")
    intervals = (
        stage_rules.groupBy("class", "days")
        .agg(F.max("stage").alias("_stage"))
        .withColumn("_until", F.lead("days").over(by_class))
        .select(F.col("class").alias("_class"), F.col("days").alias("_from"), "_until", "_stage")
    )
    age = F.datediff(day, F.col("created"))
    reached = (
        (F.col("class") == F.col("_class")) & (age >= F.col("_from")) & (F.col("_until").isNull() | (age < F.col("_until")))
    )
    stage = F.when(F.col("created") > day, "not_yet").when(F.col("created") <= day, F.coalesce("_stage", F.lit("standard")))
    return objects.join(intervals, reached, "left").select(*objects.columns, stage.alias("stage"))


def dead_letters(receives: DataFrame, limits: DataFrame, as_of: str) -> DataFrame:
    """Messages received more often than their queue allows; they expire two weeks after the last receive.

    Messages of a queue without a limit, or without a queue, are rows with an ``error`` and no expiry.
    """
    counted = receives.groupBy("queue", "message_id").agg(
        F.count("*").alias("receives"), F.max("ts").cast("date").alias("last_received")
    )
    expires, known = F.date_add("last_received", rules.DEAD_LETTER_DAYS), F.col("max_receives").isNotNull()
    return (
        counted.join(limits, "queue", "left")
        .filter(F.coalesce(F.col("receives") > F.col("max_receives"), F.lit(True)))
        .select(
            "queue", "message_id", "receives", F.when(known, expires).alias("expires_on"),
            F.when(known, expires <= F.lit(as_of).cast("date")).alias("expired"),
            F.when(~known, F.concat(F.lit("queue without a limit: "), F.coalesce("queue", F.lit("none")))).alias("error"),
        )
    )


def rotation_due(rotations: DataFrame, keys: list[str], as_of: str, days: int = rules.ROTATION_DAYS) -> DataFrame:
    """Per credential the days since its latest rotation up to ``as_of``, and its state.

    ``due`` after more than ``days``, else ``current``; ``not_yet`` if all rotations are later,
    ``unknown`` if none has a date. Callers filter on the state.
    """
    day = F.lit(as_of).cast("date")
    last = F.max(F.when(F.col("rotated_at") <= day, F.col("rotated_at")))
    found = rotations.groupBy(*keys).agg(F.datediff(day, last).alias("age_days"), F.count("rotated_at").alias("_dated"))
    state = (
        F.when(F.col("age_days") > days, "due").when(F.col("age_days").isNotNull(), "current")
        .when(F.col("_dated") > 0, "not_yet").otherwise("unknown")
    )
    return found.withColumn("state", state).drop("_dated")
