"""Map overlays in which the later entry wins, whatever the session says about duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "cast(map() as map<string,string>)"


def empty_map() -> Column:
    return F.expr(EMPTY)


def text_map(pairs: dict[str, Column | str]) -> Column:
    """A map of fixed, distinct keys."""
    items = []
    for key, value in pairs.items():
        items += [F.lit(key), F.lit(value) if isinstance(value, str) else value]
    return F.create_map(*items)


def _without_keys(base: str, top: str) -> Column:
    return F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))


def overlay(df: DataFrame, name: str, *layers: Column) -> DataFrame:
    """Add ``name``: the layers from weakest to strongest; a null layer counts as empty.

    Every layer is a column of its own before it is used, so that the test for a stronger
    key looks at a value and does not build the stronger map again for each key.
    """
    own = [f"_layer{i}" for i in range(len(layers))]
    staged = df.withColumns({c: F.coalesce(layer, empty_map()) for c, layer in zip(own, layers)})
    for weak, strong in zip(own, own[1:]):
        merged = F.map_concat(_without_keys(weak, strong), strong)
        staged = staged.withColumn(
            strong, F.when(F.size(strong) == 0, F.col(weak)).when(F.size(weak) == 0, F.col(strong)).otherwise(merged)
        )
    return staged.withColumn(name, F.col(own[-1])).drop(*own)


def map_of_last(df: DataFrame, name: str, entries: Column, key: str = "key") -> DataFrame:
    """Add ``name``: a map of (key, value) structs in which the last of equal keys counts.

    Keys are normally distinct; the search for later ones only runs where they are not.
    """
    staged = df.withColumn("_entries", entries).withColumn("_keys", F.transform("_entries", lambda e: e[key]))
    last = F.filter(
        "_entries",
        lambda e, i: F.array_position(F.reverse("_keys"), e[key]) == F.size("_keys") - i,
    )
    distinct = F.size(F.array_distinct("_keys")) == F.size("_keys")
    return (
        staged.withColumn("_entries", F.when(distinct, F.col("_entries")).otherwise(last))
        .withColumn(name, F.map_from_entries("_entries"))
        .drop("_entries", "_keys")
    )


def map_text(c: Column) -> Column:
    """``k=v`` pairs in key order, for reports and comparisons."""
    pairs = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.array_join(F.array_sort(pairs), ";")
