"""Exports, imports and the order of stacks."""

from __future__ import annotations

import logging
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import rules
from fleetlens.functions import naming
from fleetlens.session import measured

LOG = logging.getLogger(__name__)


def _edge_names(contexts: DataFrame, table: DataFrame) -> DataFrame:
    """Every rule row of a context, from one small array per row instead of a join of all pairs."""
    items = table.agg(F.array_sort(F.collect_list(F.struct("stack", "scope", "suffix")))).scalar()
    rows = contexts.select("*", F.explode(items).alias("_r"))
    return rows.select(
        *contexts.columns,
        F.col("_r.stack").alias("stack"),
        F.when(F.col("_r.scope") == "app", naming.export_name("_r.suffix"))
        .otherwise(naming.export_name("_r.suffix", app=None))
        .alias("name"),
    )


def expected_exports(contexts: DataFrame) -> DataFrame:
    """The outputs the stacks of each context (env_name, app_name) publish."""
    return _edge_names(contexts, rules.stack_exports(contexts.sparkSession))


def expected_imports(contexts: DataFrame) -> DataFrame:
    return _edge_names(contexts, rules.stack_imports(contexts.sparkSession))


def secret_exports(requested: DataFrame) -> DataFrame:
    """The outputs for secrets: one per secret that a context (env_name, app_name) asks for, imported or created."""
    return requested.select("env_name", "app_name", "secret_name").distinct().withColumn(
        "name", naming.export_name(F.concat("secret_name", F.lit(rules.SECRET_EXPORT_SUFFIX)))
    )


def unresolved_imports(imports: DataFrame, exports: DataFrame, keys: list[str]) -> DataFrame:
    """Imports that no stack exports; the exports are reduced to their distinct keys.

    ``keys`` are the name and whatever bounds an export: account and region.
    """
    return imports.join(exports.select(*keys).distinct(), keys, "left_anti")


def duplicate_exports(exports: DataFrame, keys: list[str]) -> DataFrame:
    """Names exported more than once where they must be unique."""
    return exports.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def undeclared_dependencies(
    imports: DataFrame, exports: DataFrame, declared: DataFrame, keys: list[str], stack: str = "stack"
) -> DataFrame:
    """(stack, depends_on) pairs that imports imply and ``declared`` lacks.

    An export name has one owner; where it is duplicated the smallest stack counts and
    ``duplicate_exports`` reports the rest. The join therefore never multiplies imports.
    """
    owners = exports.groupBy(*keys).agg(F.min(stack).alias("depends_on"))
    pairs = (
        imports.select(*keys, stack).distinct().join(owners, keys)
        .filter(F.col(stack) != F.col("depends_on"))
        .select(stack, "depends_on").distinct()
    )
    return pairs.join(declared.select(stack, "depends_on").distinct(), [stack, "depends_on"], "left_anti")


def list_import_items(exports: DataFrame, joined: str = "joined") -> DataFrame:
    """Comma-joined values back to rows, with the list's size and whether it is as expected.

    A missing list is one row without item, size and verdict.
    """
    items = F.split(joined, ",")
    size = F.when(F.col(joined).isNotNull(), F.size(items))
    kept = [c for c in exports.columns if c != joined]
    return exports.select(
        *kept,
        size.alias("n_items"),
        (size == rules.LIST_EXPORT_ITEMS).alias("size_ok"),
        F.posexplode_outer(items).alias("pos", "item"),
    )


def join_list_export(items: DataFrame, keys: list[str]) -> DataFrame:
    """The export side of :func:`list_import_items`: items in order, joined by commas."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item")))
    text = F.array_join(F.transform(ordered, lambda s: s["item"]), ",")
    return items.groupBy(*keys).agg(F.when(F.count("pos") > 0, text).alias("joined"))


#: Rows of one key from which on its row of a table is sent to them all, instead of them to it.
HOT = 20_000


def _together(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both in no more parts than a shuffle has, however often the result is split and put together again."""
    return one.unionByName(other).coalesce(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _looked_up(rows: DataFrame, key: str, table: DataFrame, known: str) -> DataFrame:
    """``rows`` left joined by ``key`` with ``table``, which has a row at most for each value of ``known``.

    Keys with more than ``HOT`` rows, of which there are few, meet a broadcast part of the table, so
    that a node on which half the graph hangs does not put it into one task.
    """
    many = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT)
    hot = [r[0] for r in many.select(key).collect()]
    if not hot:
        return rows.join(table, F.col(key) == F.col(known), "left")
    often = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(table.filter(F.col(known).isin(hot)))
    same = F.col(key) == F.col(known)
    return _together(rows.filter(~often).join(table, same, "left"), rows.filter(often).join(few, same, "left"))


def _collapsed_chains(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one dependency as (node, to, dist): the end of their chain and how far it is.

    Every round doubles the reach, so rounds follow the logarithm of the longest chain. What
    still moves after reaching further than there are nodes runs in a circle; these nodes
    are the second result.
    """
    jumps = measured(single.withColumn("moved", F.lit(True)))
    moving = jumps.count()
    for i in range(moving.bit_length() + 1):
        hop = jumps.select(F.col("node").alias("_via"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
        # what has come to its end is at one of few nodes and is not asked for again
        further = _looked_up(jumps.filter("moved"), "to", hop, "_via").select(
            "node", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            F.col("_via").isNotNull().alias("moved"),
        )
        jumps = measured(_together(further, jumps.filter("NOT moved")))
        before, moving = moving, jumps.filter("moved").count()
        # if none came to an end between one reach and its double, none is at the end of a longer chain
        if not moving or (i and moving == before):
            LOG.info("chains collapsed in %d rounds", i + 1)
            break
    return jumps.filter("NOT moved").drop("moved"), jumps.filter("moved").select("node")


#: Nodes of a cluster that one task settles or colours by itself.
MOST = 20_000


def _clusters(edges: DataFrame, most: int) -> DataFrame:
    """(node, cluster) of the nodes with an edge (node, target): neighbours together, about ``most`` nodes each.

    Each node is hung on one target. Trees of this forest share a bucket by their root, and a
    bucket is cut by depth into slices, so that a long way through the graph crosses few
    clusters. A slice that is still too wide is split by node. Only the number of rounds
    depends on the choice, not the result.
    """
    nodes = measured(edges.select("node").union(edges.select("target")).distinct())
    total = nodes.count()
    if total <= most:
        return nodes.withColumn("cluster", F.lit("all"))
    hung = edges.filter("node <> target").groupBy("node").agg(F.max("target").alias("to")).withColumn("dist", F.lit(1))
    ends, circling = _collapsed_chains(hung)
    rooted = ends.select("node", F.col("to").alias("root"), F.col("dist").alias("depth"))
    rooted = rooted.unionByName(circling.select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("root"), F.lit(0).alias("depth")))
    placed = nodes.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(-(-total // most))))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))
    part = F.floor(F.col("depth") * F.ceil(F.col("n") / most) / (F.col("deepest") + 1))
    sliced = placed.join(sizes, "bucket").select("node", "bucket", part.alias("slice"))
    widths = sliced.groupBy("bucket", "slice").agg(F.ceil(F.count("*") / most).alias("parts"))
    share = F.pmod(F.xxhash64("node"), F.col("parts"))
    return measured(sliced.join(widths, ["bucket", "slice"]).select("node", F.concat_ws(".", "bucket", "slice", share).alias("cluster")))


def _settle_cluster(table: pa.Table) -> pa.Table:
    """Levels of the nodes of one cluster that only wait for each other.

    Rows without a target give what a node knows: its level by settled targets, and whether it
    waits for another cluster. Rows with one are edges inside the cluster.
    """
    level, waits, above = {}, {}, {}
    for node, target, weight, known, blocked in zip(*(table[c].to_pylist() for c in ("node", "target", "weight", "known", "blocked"))):
        if target is None:
            level[node] = known or 0
            waits[node] = waits.get(node, 0) + blocked
        else:
            above.setdefault(target, []).append((node, weight))
            waits[node] = waits.get(node, 0) + 1
    free = [node for node, n in waits.items() if not n]
    done = []
    while free:
        node = free.pop()
        done.append(node)
        for other, weight in above.get(node, ()):
            level[other] = max(level[other], level[node] + weight)
            waits[other] -= 1
            if not waits[other]:
                free.append(other)
    return pa.table({"node": pa.array(done, table.schema.field("node").type), "level": pa.array([level[n] for n in done], pa.int32())})


def _levels(known: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node, level) of the nodes that no cycle lies below; ``edges`` (node, depends_on) are between ``known`` nodes.

    Chains of nodes with one dependency are collapsed first. The rest is cut into clusters.
    Each round settles within every cluster all nodes that wait for no other cluster, and then
    tells the levels across; one checkpoint of the open edges. So rounds follow the logarithm
    of the longest chain plus the number of clusters that the longest way crosses.
    """
    degree = edges.groupBy("node").agg(F.count("*").alias("_n"), F.min("depends_on").alias("to"))
    chains, _ = _collapsed_chains(degree.filter("_n = 1").select("node", "to", F.lit(1).alias("dist")))
    roots = measured(known.join(edges, "node", "left_anti"))
    ends = chains.select(F.col("node").alias("_node"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
    at_once = roots.select(F.col("node").alias("_root"), F.lit(0).alias("_level"))
    shortened = measured(
        _looked_up(edges.join(degree.filter("_n > 1"), "node", "left_semi"), "depends_on", ends, "_node")
        .select("node", F.coalesce("_to", "depends_on").alias("target"), (F.coalesce("_dist", F.lit(0)) + 1).alias("weight"))
    )
    open_edges = measured(
        _looked_up(shortened, "target", at_once, "_root").select("node", "target", "weight", F.col("_level").alias("level"))
    )
    settled, rounds = [roots.withColumn("level", F.lit(0))], 0
    if not open_edges.isEmpty():
        where = _clusters(open_edges.select("node", "target"), most)
        other = where.select(F.col("node").alias("_target"), F.col("cluster").alias("_other"))
        open_edges = measured(
            _looked_up(open_edges.join(where, "node"), "target", other, "_target")
            .select("cluster", "node", "target", "weight", "level", (F.col("cluster") == F.col("_other")).alias("inside"))
        )
    node_type = known.schema["node"].dataType.simpleString()
    while rounds or not open_edges.isEmpty():
        unknown = F.col("level").isNull()
        told = open_edges.groupBy("cluster", "node").agg(
            F.lit(None).cast(node_type).alias("target"), F.lit(None).cast("int").alias("weight"),
            F.max(F.col("level") + F.col("weight")).alias("known"), F.bool_or(unknown & ~F.col("inside")).alias("blocked"),
        )
        inner = open_edges.filter(unknown & F.col("inside")).select(
            "cluster", "node", "target", "weight", F.lit(None).cast("int").alias("known"), F.lit(False).alias("blocked")
        )
        now = measured(told.unionByName(inner).groupBy("cluster").applyInArrow(_settle_cluster, f"node {node_type}, level int"))
        if now.isEmpty():
            break
        rounds += 1
        settled.append(now)
        fresh = now.select(F.col("node").alias("_node"), F.col("level").alias("_level"))
        open_edges = measured(
            _looked_up(open_edges.join(now.select("node"), "node", "left_anti"), "target", fresh, "_node")
            .select("cluster", "node", "target", "weight", F.coalesce("level", "_level").alias("level"), "inside")
        )
        if open_edges.isEmpty():
            break
    LOG.info("joins settled in %d rounds", rounds)
    found = reduce(DataFrame.unionByName, settled)
    below = found.select(F.col("node").alias("_end"), "level")
    behind = _looked_up(chains, "to", below, "_end").filter("level IS NOT NULL").select("node", (F.col("level") + F.col("dist")).alias("level"))
    return measured(found.unionByName(behind))


def _spread_cluster(table: pa.Table) -> pa.Table:
    """The greatest label that reaches each node of one cluster; rows without a target are the nodes."""
    label, ways = {}, {}
    for node, target, own in zip(*(table[c].to_pylist() for c in ("node", "target", "label"))):
        if target is None:
            label[node] = own
        else:
            ways.setdefault(node, []).append(target)
    seen = set()
    for node in sorted(label, key=label.get, reverse=True):
        todo = [] if node in seen else [node]
        seen.add(node)
        while todo:
            for other in ways.get(todo.pop(), ()):
                if other not in seen:
                    seen.add(other)
                    label[other] = label[node]
                    todo.append(other)
    return pa.table({"node": pa.array(list(label), table.schema.field("node").type), "label": pa.array(list(label.values()), pa.int64())})


def _spread(edges: DataFrame, labels: DataFrame, where: DataFrame) -> DataFrame:
    """(node, label): the greatest label of all nodes that lead to it by ``edges`` (node, target), its own included."""
    node_type = labels.schema["node"].dataType.simpleString()
    other = where.select(F.col("node").alias("target"), F.col("cluster").alias("_other"))
    placed = measured(edges.join(where, "node").join(other, "target"))
    inner = placed.filter("cluster = _other").select("cluster", "node", "target", F.lit(None).cast("bigint").alias("label"))
    across = placed.filter("cluster <> _other").select("node", "target")
    state, rounds = measured(labels), 0
    while True:
        rows = state.join(where, "node").select("cluster", "node", F.lit(None).cast(node_type).alias("target"), "label")
        inside = measured(rows.unionByName(inner).groupBy("cluster").applyInArrow(_spread_cluster, f"node {node_type}, label bigint"))
        rounds += 1
        told = across.join(inside, "node").groupBy(F.col("target").alias("node")).agg(F.max("label").alias("_told"))
        joined = inside.join(told, "node", "left")
        state = measured(joined.select("node", F.greatest("label", "_told").alias("label"), (F.col("_told") > F.col("label")).alias("_moved")))
        if state.filter("_moved").isEmpty():
            LOG.info("labels spread in %d rounds", rounds)
            return state.select("node", "label")
        state = state.drop("_moved")


def _cycles_of_one(table: pa.Table) -> pa.Table:
    """Strongly connected components of a graph that fits a task, by depth-first search without recursion."""
    ways: dict = {}
    for node, target in zip(table["node"].to_pylist(), table["depends_on"].to_pylist()):
        ways.setdefault(node, []).append(target)
    number, lowest, stack, held, out = {}, {}, [], set(), []
    for start in ways:
        if start in number:
            continue
        number[start] = lowest[start] = len(number)
        stack.append(start)
        held.add(start)
        path = [(start, iter(ways[start]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in number:
                    number[other] = lowest[other] = len(number)
                    stack.append(other)
                    held.add(other)
                    path.append((other, iter(ways.get(other, ()))))
                    break
                if other in held:
                    lowest[node] = min(lowest[node], number[other])
            else:
                path.pop()
                if path:
                    lowest[path[-1][0]] = min(lowest[path[-1][0]], lowest[node])
                if lowest[node] == number[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    held.difference_update(part)
                    if len(part) > 1 or node in ways.get(node, ()):
                        out += [(member, min(part)) for member in part]
    kind = table.schema.field("node").type
    return pa.table({"node": pa.array([n for n, _ in out], kind), "cycle_id": pa.array([c for _, c in out], kind)})


def cycles(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(node, cycle_id) of the nodes of ``edges`` (node, depends_on) that depend on themselves.

    Nodes of one strongly connected component share the least of them as ``cycle_id``. Nodes
    with no cycle below or above them are trimmed from the ends, and what that leaves by levels in
    both directions. The rest is coloured: the greatest label that leads to a node is its colour, and the nodes of a colour
    that lead back to the node with that label form a component. Labels are dealt by hash, so
    that few passes find all components; both walks run to the end within clusters and
    exchange across, so a long cycle takes as many rounds as it crosses clusters. A graph of at
    most ``most`` edges is searched by one task.
    """
    edges = measured(edges.select("node", "depends_on").filter("node IS NOT NULL AND depends_on IS NOT NULL").distinct())
    node_type = edges.schema["node"].dataType.simpleString()
    n = edges.count()
    while n > most:
        # nodes without an edge on either side go, as long as that takes a good part of them
        asked, asking = edges.select(F.col("depends_on").alias("node")).distinct(), edges.select(F.col("node").alias("_asking")).distinct()
        inner = _looked_up(edges.join(asked, "node", "left_semi"), "depends_on", asking, "_asking").filter("_asking IS NOT NULL")
        edges = measured(inner.select("node", "depends_on"))
        before, n = n, edges.count()
        if n > 0.75 * before:
            break
    if n <= most:
        return edges.withColumn("_all", F.lit(1)).groupBy("_all").applyInArrow(_cycles_of_one, f"node {node_type}, cycle_id {node_type}")
    for _ in range(2):
        nodes = edges.select("node").union(edges.select("depends_on")).distinct()
        level = _levels(nodes, edges, most).select("node")
        left = edges.join(level, "node", "left_anti").join(level.withColumnRenamed("node", "depends_on"), "depends_on", "left_anti")
        # the second time round the edges are turned, to trim from the other end, and then turned back
        edges = measured(left.select(F.col("depends_on").alias("node"), F.col("node").alias("depends_on")))
    self_made = edges.filter("node = depends_on").select("node")
    found = None
    while not edges.isEmpty():
        ways = edges.select("node", F.col("depends_on").alias("target"))
        where = _clusters(ways, most)
        order = where.select("node").repartition("node").sortWithinPartitions(F.xxhash64("node"))
        labels = measured(order.select("node", F.monotonically_increasing_id().alias("label")))
        colour = _spread(ways, labels, where)
        of = colour.select(F.col("node").alias("target"), F.col("label").alias("_colour"))
        same = measured(ways.join(colour, "node").join(of, "target").filter("label = _colour").select("node", "target"))
        marks = labels.withColumnRenamed("label", "_own").join(colour, "node").select("node", (F.col("_own") == F.col("label")).cast("bigint").alias("label"))
        back = _spread(same.select(F.col("target").alias("node"), F.col("node").alias("target")), marks, where).filter("label = 1")
        members = measured(back.select("node").join(colour, "node"))
        parts = members.groupBy("label").agg(F.min("node").alias("cycle_id"), F.count("*").alias("_n"))
        round_found = measured(members.join(parts, "label").select("node", "cycle_id", "_n"))
        found = round_found if found is None else found.unionByName(round_found)
        rest = same.join(round_found.select("node"), "node", "left_anti")
        rest = rest.join(round_found.select(F.col("node").alias("target")), "target", "left_anti")
        edges = measured(rest.select("node", F.col("target").alias("depends_on")))
    if found is None:
        return self_made.select("node", F.col("node").alias("cycle_id"))
    alone = self_made.withColumn("_self", F.lit(True))
    real = found.join(alone, "node", "left").filter("_n > 1 OR _self")
    return real.select("node", "cycle_id")


def deploy_levels(nodes: DataFrame, deps: DataFrame, most: int = MOST) -> DataFrame:
    """Level of each node: one more than its deepest dependency; 0 without dependencies.

    ``nodes`` has node and declared_order, ``deps`` node and depends_on. Nodes of a cycle have no
    level, are ``in_cycle`` and carry its least node as ``cycle_id``; other nodes without a level
    are ``behind_cycle``. ``order_violation`` marks a declared order that is not above those of
    all its dependencies. A null dependency is none, and one outside ``nodes`` counts as settled.
    """
    known = nodes.select("node").filter("node IS NOT NULL").distinct()
    edges = measured(
        deps.select("node", "depends_on").distinct()
        .join(known, "node", "left_semi")
        .join(known.withColumnRenamed("node", "depends_on"), "depends_on", "left_semi")
        .select("node", "depends_on")
    )
    settled = _levels(known, edges, most)
    circles = cycles(edges.join(settled, "node", "left_anti"), most)
    order = nodes.groupBy("node").agg(F.max("declared_order").alias("declared_order"))
    highest = (
        deps.join(order.select(F.col("node").alias("depends_on"), F.col("declared_order").alias("_o")), "depends_on")
        .groupBy("node").agg(F.max("_o").alias("_highest"))
    )
    found = known.join(settled, "node", "left").join(circles, "node", "left").join(order, "node", "left").join(highest, "node", "left")
    return found.select(
        "node",
        "level",
        "declared_order",
        F.col("cycle_id").isNotNull().alias("in_cycle"),
        "cycle_id",
        (F.col("level").isNull() & F.col("cycle_id").isNull()).alias("behind_cycle"),
        F.coalesce(F.col("declared_order") <= F.col("_highest"), F.lit(False)).alias("order_violation"),
    )
