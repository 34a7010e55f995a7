"""Tags, endpoints, existence and drift over inventory tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import checkpointed


def tag_violations(resources: DataFrame, required: DataFrame, keep: list[str]) -> DataFrame:
    """Resources (scope, tags) against required tags (scope, tag, expected).

    A null ``expected`` asks for the tag with any value. Missing and wrong are told apart.
    """
    joined = resources.join(required, "scope")
    actual = F.element_at("tags", F.col("tag"))
    return (
        joined.withColumn("actual", actual)
        .withColumn(
            "problem",
            F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "wrong"),
        )
        .filter("problem IS NOT NULL")
        .select(*keep, "tag", "expected", "actual", "problem")
    )


def endpoint_availability(endpoints: DataFrame, required: DataFrame) -> DataFrame:
    """Per required service the number of endpoints and the state of the first one."""
    per_service = endpoints.groupBy("service").agg(
        F.count("*").alias("_n"), F.min_by("state", "pos").alias("_state")
    )
    return required.join(per_service, "service", "left").select(
        *required.columns,
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_endpoints"),
        F.when(F.col("_n").isNull(), "none").otherwise(F.col("_state")).alias("status"),
    )


def existence(required: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys as present or missing; a present one without a key id uses ``default``.

    The inventory may list a key many times; it is reduced to one row before the join.
    """
    found = inventory.groupBy(*keys).agg(F.max("kms_key_id").alias("_kms"), F.lit(True).alias("_found"))
    return required.join(found, keys, "left").select(
        *required.columns,
        F.coalesce("_found", F.lit(False)).alias("present"),
        F.when(F.col("_found"), F.coalesce("_kms", F.lit("default"))).alias("kms_key_id"),
    )


#: Copies of a repeated row that one step makes.
STEP = 1000


def drift(expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of (keys, change, column, from, to). Added and removed rows appear once each.

    Values are compared null-safely and reported as text; null keys are keys like others.
    Rows that both sides hold equally often cancel out first, in one aggregation with
    map-side combine, so that only differences are looked at by key and a table never
    differs from itself. A key left with several rows on one side and some on the other is
    ``ambiguous``: how many rows each side has too many. Rows of one key that are repeated are
    multiplied from their count, a bounded number in each step, never held in one list.
    """
    side = lambda df, sign: df.select(
        *keys, *[F.col(c).cast("string").alias(c) for c in columns], F.lit(sign).alias("_s")
    )
    rows = side(expected, 1).unionByName(side(actual, -1))
    left = rows.groupBy(*keys, *columns).agg(F.sum("_s").cast("int").alias("_d")).filter("_d <> 0")
    more, fewer = F.col("_d") > 0, F.col("_d") < 0
    values = F.struct(*columns)
    by_key = left.groupBy(*keys).agg(
        F.sum(F.greatest("_d", F.lit(0))).cast("int").alias("_gone"),
        F.sum(F.greatest(-F.col("_d"), F.lit(0))).cast("int").alias("_new"),
        F.max(F.when(more, values)).alias("_e"),
        F.max(F.when(fewer, values)).alias("_a"),
    )
    text = F.lit(None).cast("string")
    item = lambda change, column, old, new: F.struct(
        F.lit(change).alias("change"), column.alias("column"), old.alias("from"), new.alias("to")
    )
    changed = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")),
                    item("changed", F.lit(c), F.col(f"_e.{c}"), F.col(f"_a.{c}")),
                )
                for c in columns
            ]
        )
    )
    found = (
        F.when(F.col("_new") == 0, F.array(item("removed", text, text, text)))
        .when(F.col("_gone") == 0, F.array(item("added", text, text, text)))
        .when((F.col("_gone") == 1) & (F.col("_new") == 1), changed)
        .otherwise(F.array(item("ambiguous", text, F.col("_gone").cast("string"), F.col("_new").cast("string"))))
    )
    told = by_key.select(*keys, F.explode_outer(found).alias("_d"), (F.col("_gone") + F.col("_new")).alias("_n"))
    # rows that are there n times: n in pieces of STEP, each piece a short list
    often = F.when(F.col("_d.change").isin("added", "removed"), F.col("_n")).otherwise(1)
    pieces = told.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((often - 1) / STEP)))).withColumn("_often", often)
    within = F.least(F.lit(STEP), F.col("_often") - F.col("_piece") * STEP).cast("int")
    return pieces.select(*keys, "_d", F.explode(F.sequence(F.lit(1), within)).alias("_i")).select(*keys, "_d.*")


def differing_ranges(expected: DataFrame, actual: DataFrame, columns: list[str], levels: list[Column]) -> list[DataFrame]:
    """The ranges of each level in which two tables differ; a level's column is ``_range_i``.

    ``levels`` are expressions over the rows, each finer than the one before, such as a day and an
    hour, or a key divided by a width. A range's digest is the number of its rows and the sum
    of their hashes, whatever their order: one aggregation with map-side combine, in which only
    digests move. A finer level is looked at only within the ranges that differ. Two tables
    that differ have equal digests with a probability of about 2**-64 for each range.
    """
    names = [f"_range_{i}" for i in range(len(levels))]
    side = lambda df, sign: df.select(
        *[level.alias(name) for level, name in zip(levels, names)],
        F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]).cast("decimal(38,0)").alias("_hash"),
        F.lit(sign).alias("_s"),
    )
    rows = side(expected, 1).unionAll(side(actual, -1))
    found: list[DataFrame] = []
    for i in range(len(levels)):
        if found:
            rows_in = _within(rows, found[-1], names[:i])
        else:
            rows_in = rows
        sums = rows_in.groupBy(*names[: i + 1]).agg(F.sum("_s").alias("_n"), F.sum(F.col("_hash") * F.col("_s")).alias("_h"))
        found.append(checkpointed(sums.filter("_n <> 0 OR _h <> 0").select(*names[: i + 1])))
    return found


def _within(rows: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """Rows that lie in ``ranges``; null ranges are ranges like others."""
    other = ranges.select(*[F.col(n).alias(f"{n}_of") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_of")) for n in names])
    return rows.join(other, same, "left_semi")


def drift_by_ranges(
    expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str], levels: list[Column]
) -> DataFrame:
    """As ``drift``, but only rows of ranges whose digests differ are compared.

    ``levels`` must be expressions over ``keys``, so that a key lies in one range on both sides.
    """
    finest = differing_ranges(expected, actual, [*keys, *columns], levels)[-1]
    names = [f"_range_{i}" for i in range(len(levels))]
    near = lambda df: _within(df.withColumns(dict(zip(names, levels))), finest, names).select(*df.columns)
    return drift(near(expected), near(actual), keys, columns)


def document_values(docs: DataFrame, keys: list[str], document: str, depth: int = 8) -> DataFrame:
    """(keys, path, value) of every leaf of a variant column, members by name and elements by place.

    Names are lower-cased, as documents spell them in any case, and dots in them escaped; equal documents give equal rows
    whatever the order of members, white space or spelling of numbers. Empty objects and arrays
    and nulls are leaves. What lies deeper than ``depth`` is one leaf, its JSON text. A null
    document has no rows.
    """
    given = F.when(F.col(document).isNotNull(), F.array(F.col(document)))
    level = docs.select(*keys, F.lit("$").alias("path"), F.explode(given).alias("_v"))
    for _ in range(depth):
        name = F.regexp_replace(F.lower("_e.key"), r"([.\[\\])", r"\\$1")
        step = F.coalesce(F.concat(F.lit("."), name), F.concat(F.lit("["), F.col("_e.pos"), F.lit("]")), F.lit(""))
        level = level.select(*keys, "path", F.explode(_entries()).alias("_e"))
        level = level.select(*keys, F.concat("path", step).alias("path"), F.col("_e.value").alias("_v"))
    leaf = F.coalesce(F.try_variant_get("_v", "$", "string"), F.when(F.is_variant_null("_v"), F.lit("null")), F.to_json("_v"))
    return level.select(*keys, "path", leaf.alias("value"))


def _entries() -> Column:
    """The members or elements of a variant ``_v``; of one without any, the variant itself."""
    members = F.expr(
        "transform(map_entries(try_variant_get(_v, '$', 'map<string,variant>')), "
        "e -> struct(CAST(NULL AS INT) AS pos, e.key AS key, e.value AS value))"
    )
    elements = F.expr(
        "transform(try_variant_get(_v, '$', 'array<variant>'), (e, i) -> struct(i AS pos, CAST(NULL AS STRING) AS key, e AS value))"
    )
    itself = F.expr("array(struct(CAST(NULL AS INT) AS pos, CAST(NULL AS STRING) AS key, _v AS value))")
    return F.when(F.size(members) > 0, members).when(F.size(elements) > 0, elements).otherwise(itself)


def document_drift(expected: DataFrame, actual: DataFrame, keys: list[str], document: str, depth: int = 8) -> DataFrame:
    """``drift`` of documents held as variants: (keys, path, change, from, to)."""
    found = drift(document_values(expected, keys, document, depth), document_values(actual, keys, document, depth), [*keys, "path"], ["value"])
    return found.drop("column")


def rule_differences(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """Multiset difference in both directions: side (missing or unexpected) and how many.

    Counting +1 and -1 per distinct row needs one aggregation with map-side combine, where
    two multiset differences would shuffle both sides twice.
    """
    signed = expected.select(*columns, F.lit(1).alias("_s")).unionByName(
        actual.select(*columns, F.lit(-1).alias("_s"))
    )
    return (
        signed.groupBy(*columns)
        .agg(F.sum("_s").alias("_d"))
        .filter("_d <> 0")
        .select(
            *columns,
            F.when(F.col("_d") > 0, "missing").otherwise("unexpected").alias("side"),
            F.abs("_d").cast("bigint").alias("n"),
        )
    )
