"""Parent-child rows turned into full hierarchies by Euler tours and list ranking.

Ranking is work-efficient: rounds of random contraction take elements out of the lists, each about a quarter of what is
left, until one task can rank the rest; then the elements taken out are put back in reverse order. Every round is one
exchange of the elements that are left, so all of them together move a few times the number of elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.operators.common import join_unique, staged

SIBLINGS = 100_000  # children of one parent that one task orders
CHUNK = 50_000  # tour positions walked by one stack
PEELS = 2  # rounds of plain leaf peeling before pointer doubling
LOCAL = 1 << 17  # links or list elements that one task finishes


def _followed(to: np.ndarray) -> np.ndarray:
    """Where pointers lead after at least as many steps as there are places; -1 for those that run out."""
    for _ in range(max(1, len(to)).bit_length()):
        to = np.where(to >= 0, to[to], -1)
    return to


def _places(frame: pd.DataFrame, *targets: list[str]) -> np.ndarray:
    """Row number of each row's target, -1 where there is none; targets are the names of key and target columns."""
    keys, wanted = targets
    at = {k: i for i, k in enumerate(zip(*(frame[c] for c in keys)))}
    return np.fromiter((at.get(k, -1) for k in zip(*(frame[c] for c in wanted))), np.int64, len(frame))


def cycle_labels(links: DataFrame) -> DataFrame:
    """(tree, node, label) of the nodes on cycles, label being the smallest of the cycle's, from links (tree, node, parent).

    All parents are nodes; roots are in no link. Leaves are peeled PEELS times. What remains is followed by pointer
    doubling: a node that nothing points to any more is on no cycle and drops out, so the rest shrinks until it has
    only cycles or until one task can finish it. Rounds grow with the logarithm of the longest chain.
    """
    core = links
    for _ in range(PEELS):
        core = core.join(core.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_semi")
    core = staged(core, "core")
    schema = ", ".join(f"{n} {t}" for n, t in core.select("tree", "node").dtypes)
    state, seen = core.select("tree", "node", F.col("parent").alias("jump")), -1
    while (left := state.count()) > LOCAL and left != seen:
        seen = left
        follow = state.select(F.struct("tree", "node").alias("at"), F.col("jump").alias("next"))
        moved = staged(join_unique(state.select("tree", "node", F.struct("tree", F.col("jump").alias("node")).alias("at")), follow, "at", "inner").select("tree", "node", F.col("next").alias("jump")), "jumps")
        state = staged(moved.join(moved.select("tree", F.col("jump").alias("node")).distinct(), ["tree", "node"], "left_semi"), "targets")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            frame = pd.concat(rows, ignore_index=True)
            to = _followed(_places(frame, ["tree", "node"], ["tree", "jump"]))
            yield frame.loc[np.unique(to[to >= 0]), ["tree", "node"]]

    on_ring = state.select("tree", "node") if left > LOCAL else state.coalesce(1).mapInPandas(ends, schema)
    ring = staged(core.join(on_ring, ["tree", "node"], "left_semi"), "ring")
    if ring.count() > LOCAL:
        return _labels_by_doubling(ring)

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            frame = pd.concat(rows, ignore_index=True)
            to = _places(frame, ["tree", "node"], ["tree", "parent"])
            order = {n: i for i, n in enumerate(sorted(frame["node"].unique()))}
            names = np.array(sorted(order, key=order.get), dtype=object)
            low = frame["node"].map(order).to_numpy()
            for _ in range(len(frame).bit_length()):
                low, to = np.minimum(low, low[to]), to[to]
            yield frame[["tree", "node"]].assign(label=names[low])

    return staged(ring.coalesce(1).mapInPandas(smallest, f"{schema}, label {dict(core.dtypes)['node']}"), "labels")


def _labels_by_doubling(ring: DataFrame) -> DataFrame:
    state = staged(ring.select("tree", "node", F.least("node", "parent").alias("label"), F.col("parent").alias("jump")), "labels")
    while True:
        ahead = state.select("tree", F.col("node").alias("jump"), F.col("label").alias("other"), F.col("jump").alias("next"))
        moved = staged(state.join(ahead, ["tree", "jump"]).select("tree", "node", F.least("label", "other").alias("label"), F.col("next").alias("jump"), (F.col("other") < F.col("label")).alias("lower")), "labels")
        state = moved.drop("lower")
        if not moved.where("lower").limit(1).count():
            return state.select("tree", "node", "label")


def with_neighbours(forest: DataFrame) -> DataFrame:
    """forest (tree, node, parent, ...), parent null for roots, with each node's first child and next sibling.

    Siblings may come in any order: children of one parent are chained inside slices of about SIBLINGS, then the slices
    are chained, so no task orders all children of a parent.
    """
    children = forest.where("parent is not null")
    most = children.groupBy("tree", "parent").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    slices = most // SIBLINGS + 1
    sliced = children.withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(slices)).cast("int"))
    inside = Window.partitionBy("tree", "parent", "slice").orderBy("node")
    chained = sliced.withColumn("sibling", F.lead("node").over(inside)).drop("slice")
    if slices == 1:
        firsts = children.groupBy("tree", F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    else:
        ends = sliced.groupBy("tree", "parent", "slice").agg(F.min("node").alias("first"), F.max("node").alias("last"))
        across = staged(ends.withColumn("after", F.lead("first").over(Window.partitionBy("tree", "parent").orderBy("slice"))), "slices")
        firsts = across.groupBy("tree", F.col("parent").alias("node")).agg(F.min_by("first", "slice").alias("child"))
        carried = across.where("after is not null").select("tree", F.col("last").alias("node"), "after")
        chained = chained.join(carried, ["tree", "node"], "left").withColumn("sibling", F.coalesce("sibling", "after")).drop("after")
    roots = forest.where("parent is null").withColumn("sibling", F.lit(None).cast(dict(forest.dtypes)["node"]))
    return chained.unionByName(roots).join(firsts, ["tree", "node"], "left")


def euler_tour(nodes: DataFrame) -> DataFrame:
    """Tour elements (tree, node, side, next_node, next_side, length, weight, root, first) from nodes with their neighbours.

    Side 0 enters a node and side 1 leaves it; a leaf has one element for both. length is the number of positions from
    the element to the next one, weight the sum of +1 and -1 over them; root is known at the list's end, and first
    marks its beginning. Roots without children are no lists.
    """
    inner, outer = F.col("child").isNotNull(), F.col("parent").isNull()
    on = {"next_node": F.coalesce("sibling", "parent"), "next_side": F.when(F.col("sibling").isNotNull(), 0).when(~outer, 1), "root": F.when(outer, F.col("node"))}

    def element(side: int, next_node, next_side, length, weight, root, first):
        return F.struct(F.lit(side).alias("side"), next_node.alias("next_node"), next_side.alias("next_side"), length.cast("long").alias("length"), weight.cast("long").alias("weight"), root.alias("root"), first.alias("first"))

    enter = element(0, F.when(inner, F.col("child")).otherwise(on["next_node"]), F.when(inner, 0).otherwise(on["next_side"]), F.when(inner, 1).otherwise(2), F.when(inner, 1).otherwise(0), F.when(~inner, on["root"]), outer)
    leave = element(1, on["next_node"], on["next_side"], F.lit(1), F.lit(-1), on["root"], F.lit(False))
    return nodes.where(inner | ~outer).select("tree", "node", F.explode(F.when(inner, F.array(enter, leave)).otherwise(F.array(enter))).alias("e")).select("tree", "node", "e.*")


def rank_lists(tour: DataFrame) -> DataFrame:
    """(tree, node, side, behind, weight, root): positions from each element on to the list's end, and their weights' sum.

    In a round every element tosses a coin; one that shows heads takes in the next one if that shows tails. Neighbours
    meet in one full join, as no two elements have the same next one. A list of one element is done and set aside.
    """
    core = ["tree", "node", "side", "next_node", "next_side", "length", "weight", "root", "first"]
    rounds: list[DataFrame] = []
    state = staged(tour, "tour")
    while state.count() > LOCAL:
        tails = F.xxhash64("node", "side", F.lit(len(rounds))).bitwiseAND(1) == 1
        one = state.where(~tails)
        other = state.where(tails).select(*[F.col(c).alias(f"o_{c}") for c in core])
        met = one.join(other, (one.tree == other.o_tree) & (one.next_node == other.o_node) & (one.next_side == other.o_side), "full")
        both, alone = F.col("node").isNotNull() & F.col("o_node").isNotNull(), F.col("node").isNull()
        take = lambda c: F.when(alone, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
        onto = lambda c: F.when(alone | both, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
        plus = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"o_{c}", F.lit(0))).alias(c)
        met = met.select(
            take("tree"), take("node"), take("side"), onto("next_node"), onto("next_side"), plus("length"), plus("weight"), F.coalesce("root", "o_root").alias("root"), take("first"),
            F.when(both, F.col("o_node")).alias("a_node"), F.when(both, F.col("o_side")).alias("a_side"), F.col("length").alias("own_length"), F.col("weight").alias("own_weight"),
        )
        rounds.append(staged(met, "contracted"))
        state = rounds[-1].where("next_node is not null or not first").select(*core)
    ids = ", ".join(f"{n} {t}" for n, t in tour.select("tree", "node", "side").dtypes)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            frame = pd.concat(rows, ignore_index=True)
            to = _places(frame, ["tree", "node", "side"], ["tree", "next_node", "next_side"])
            behind, weight, end = frame["length"].to_numpy(), frame["weight"].to_numpy(), np.arange(len(frame))
            while (more := to >= 0).any():
                behind, weight = behind + np.where(more, behind[to], 0), weight + np.where(more, weight[to], 0)
                end, to = np.where(more, end[to], end), np.where(more, to[to], -1)
            yield frame[["tree", "node", "side"]].assign(behind=behind, weight=weight, root=frame["root"].to_numpy()[end])

    ranked = state.select("tree", "node", "side", "next_node", F.col("next_side").cast("int"), "length", "weight", "root").coalesce(1).mapInPandas(rank, f"{ids}, behind long, weight long, root {dict(tour.dtypes)['node']}")
    for met in reversed(rounds):
        done = met.where("next_node is null and first").select("tree", "node", "side", F.col("length").alias("behind"), "weight", "root")
        taken = met.where("a_node is not null").select("tree", "node", "side", "a_node", "a_side", "own_length", "own_weight")
        own = F.struct("node", "side", "behind", "weight")
        put = F.struct(F.col("a_node").alias("node"), F.col("a_side").alias("side"), (F.col("behind") - F.col("own_length")).alias("behind"), (F.col("weight") - F.col("own_weight")).alias("weight"))
        back = ranked.unionByName(done).join(taken, ["tree", "node", "side"], "left")
        ranked = back.select("tree", "root", F.explode(F.when(F.col("a_node").isNotNull(), F.array(own, put)).otherwise(F.array(own))).alias("e")).select("tree", "e.*", "root")
    return ranked


def paths_from_intervals(nodes: DataFrame) -> DataFrame:
    """nodes (tree, root, node, enter, leave, depth, below) with their path: ids from the root joined by "/".

    Tours are cut into chunks of positions. A chunk starts with the ancestors that are open there - the intervals that
    contain its start - and is then walked with a stack.
    """
    rest = ["tree", "root", "node", "enter", "leave", "depth", "below"]
    own = nodes.select(*rest, F.floor(F.col("enter") / CHUNK).cast("long").alias("chunk"), F.lit(True).alias("own"))
    first, last = F.floor(F.col("enter") / CHUNK).cast("long") + 1, F.floor(F.col("leave") / CHUNK).cast("long")
    open_at = nodes.where(last >= first).select(*rest, F.explode(F.sequence(first, last)).alias("chunk"), F.lit(False).alias("own"))
    rows = own.unionByName(open_at).repartition("tree", "root", "chunk").sortWithinPartitions("tree", "root", "chunk", "enter")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack, names = None, [], []
        for batch in batches:
            paths = []
            for tree, root, node, leave, chunk, own in zip(*(batch[c].tolist() for c in ("tree", "root", "node", "leave", "chunk", "own"))):
                if at != (tree, root, chunk):
                    at, stack, names = (tree, root, chunk), [], []
                while stack and stack[-1] < leave:
                    stack.pop()
                    names.pop()
                stack.append(leave)
                names.append(f"{names[-1]}/{node}" if names else str(node))
                paths.append(names[-1] if own else None)
            yield batch.assign(path=paths)[batch["own"]][["tree", "node", "root", "depth", "path", "below"]]

    types = dict(nodes.dtypes)
    return rows.mapInPandas(walk, f"tree {types['tree']}, node {types['node']}, root {types['root']}, depth long, path string, below long")


def hierarchy(rows: DataFrame) -> DataFrame:
    """(tree, node_id, root_id, depth, path, link_state, descendants) from (tree, node, parent), one row per node.

    A null parent or one that is no node of the tree makes a root; a node that is its own parent is a cycle. See the
    module's functions for the steps. Null nodes are ignored; of several rows of a node that with the greatest parent
    counts. Trees without nodes give no rows. A node's descendants are the nodes whose tour lies inside its own, and
    intervals gives the tours.
    """
    forest, nodes, spans = _toured(rows)
    labels = forest.where("label is not null").select("tree", "node", "label")
    touring = spans.join(labels.select("tree", F.col("node").alias("root"), "label"), ["tree", "root"], "left")
    sized = touring.withColumn("below", ((F.col("behind_enter") - F.col("behind_leave") - 1) / 2).cast("long"))
    # Positions only have to be ordered, so those counted from the end serve, negated.
    placed = sized.where("label is null").select("tree", "root", "node", (-F.col("behind_enter")).alias("enter"), (-F.col("behind_leave")).alias("leave"), "depth", "below")
    out = lambda root, depth, path, state, below: (F.col(root).alias("root_id"), depth.cast("long").alias("depth"), path.alias("path"), F.lit(state).alias("link_state"), below.cast("long").alias("descendants"))
    key = (F.col("tree"), F.col("node").alias("node_id"))
    rooted = paths_from_intervals(placed).select(*key, *out("root", F.col("depth"), F.col("path"), "rooted", F.col("below")))
    # Everything that reaches a node of a cycle: the cycle and all that hangs off it.
    hanging = labels.join(sized.where("node = root").select("tree", "node", "below"), ["tree", "node"], "left")
    totals = hanging.groupBy("tree", "label").agg(F.sum(F.coalesce("below", F.lit(0)) + 1).alias("total"))
    on_cycle = labels.join(totals, ["tree", "label"]).select(*key, *out("label", F.lit(0), F.lit(""), "on_cycle", F.col("total") - 1))
    into = sized.where("label is not null and node <> root").select(*key, *out("label", F.col("depth"), F.lit(""), "into_cycle", F.col("below")))
    alone = nodes.where("parent is null and child is null and label is null").select(*key, *out("node", F.lit(0), F.col("node").cast("string"), "rooted", F.lit(0)))
    return rooted.unionByName(alone).unionByName(into).unionByName(on_cycle)


def _toured(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The forest with the labels of cycles, its nodes with their neighbours, and where each tour enters and leaves them."""
    nodes = staged(rows.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.max("parent").alias("parent")), "nodes")
    there = nodes.select(F.struct("tree", F.col("node").alias("id")).alias("up"), F.lit(True).alias("known"))
    asked = nodes.where("parent is not null").select("tree", "node", "parent", F.struct("tree", F.col("parent").alias("id")).alias("up"))
    linked = join_unique(asked, there, "up").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    linked = staged(linked.unionByName(nodes.where("parent is null")), "linked")
    labels = cycle_labels(linked.where("parent is not null"))
    # Nodes of cycles are the roots of what hangs off them.
    forest = staged(linked.join(labels, ["tree", "node"], "left").withColumn("parent", F.when(F.col("label").isNull(), F.col("parent"))), "forest")
    near = staged(with_neighbours(forest), "neighbours")
    ranked = rank_lists(euler_tour(near))
    # A leaf's one element enters and leaves it.
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    spans = ranked.groupBy("tree", "node").agg((side(0, "behind") - 1).alias("behind_enter"), F.coalesce(side(1, "behind") - 1, side(0, "behind") - 2).alias("behind_leave"), (-side(0, "weight")).alias("depth"), F.max("root").alias("root"))
    return forest, near, staged(spans, "spans")


def intervals(rows: DataFrame) -> DataFrame:
    """(tree, node_id, root_id, enter, leave): positions in the Euler tour of each node's tree, counted from 0.

    A node's descendants are the nodes of the same root whose interval lies inside its own, its ancestors those whose
    interval contains its own; nodes of cycles are roots of what hangs off them. Roots without children have (0, 1).
    """
    _, nodes, spans = _toured(rows)
    length = spans.where("node = root").select("tree", "root", (F.col("behind_enter") + 1).alias("length"))
    placed = join_unique(spans.withColumn("list", F.struct("tree", "root")), length.select(F.struct("tree", "root").alias("list"), "length"), "list", "inner")
    out = placed.select("tree", F.col("node").alias("node_id"), F.col("root").alias("root_id"), (F.col("length") - 1 - F.col("behind_enter")).alias("enter"), (F.col("length") - 1 - F.col("behind_leave")).alias("leave"))
    alone = nodes.where("parent is null and child is null").select("tree", F.col("node").alias("node_id"), F.col("node").alias("root_id"), F.lit(0).cast("long").alias("enter"), F.lit(1).cast("long").alias("leave"))
    return out.unionByName(alone)
