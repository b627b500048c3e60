"""The trie of conversation openings, and sums over its subtrees by centroid decomposition.

A node is a sequence of turns that some conversation begins with; its name is a digest of the digests of
its turns. It belongs to the smallest conversation that has it, so (conv_id, depth) tells nodes apart,
and what a conversation owns is the end of its path. The owners on a path never get smaller with depth, and the
weight of a node (the nodes of its members from it on, each member counted) never gets larger: parents, tops of
components and leaves follow from minima and maxima over the rows of a path.

Sums over subtrees: nodes of little weight hang below the heavy ones in whole subtrees of bounded size, each a
component; the heavy nodes are one more. A component is split at its centroid, the deepest node with more than half
of its weight. What lies below the centroid is summed up, and added to the nodes from the centroid to the
component's top, whose weights drop by as much; the parts go on by themselves. So a chain of a million turns
takes twenty rounds. Components too large for a task are split by joins, the others inside tasks, all of a task at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

#: Turns of one conversation that a task has in a row, nodes of a component that a task splits, and nodes that it holds at once.
BLOCK, COMPONENT, HELD = 4096, 50_000, 200_000
#: Members whose ids are put together before a node's ids are hashed in a row.
IDS = 1 << 15


def _digest(*parts) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def ordered_turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, name, n_chars) of every turn: its place in its conversation from 0, a digest of role and text, the text's length.

    Turns are in the order of ``turn``, null first; those of one turn by their digests. Null roles and texts are
    empty; rows without a conv_id belong to no conversation. Places are counted inside blocks of ``turn`` values, so
    a long conversation is no single task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _digest(F.length(role).cast("string"), F.lit(":"), role, F.lit("\n"), text).alias("name"), F.length(text).alias("n_chars"),
    ).withColumn("block", F.floor(F.col("turn") / block))
    blocks = rows.groupBy("conv_id", F.coalesce("block", F.lit(-(1 << 62))).alias("block")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")
    at = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "name")) - 1
    placed = rows.withColumn("block", F.coalesce("block", F.lit(-(1 << 62)))).withColumn("at", at)
    return placed.join(blocks.select("conv_id", "block", before.alias("before")), ["conv_id", "block"]).select(
        "conv_id", (F.col("at") + F.col("before")).alias("place"), "name", "n_chars"
    )


def with_shared_openings(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share openings: new turns (with ``size``), and (conv_id, size) of all conversations.

    The first h turns of a conversation are put in place by those of conversation ``conv_id - conv_id % every`` as
    it was, all of them if it has fewer, none if there is no such one; h is crc32(conv_id) % ``most``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = turns.where(F.col("place") < most - 1).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "name", "n_chars"))).alias("opening")
    )
    conversations = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h.cast("int"), "base": F.col("conv_id") - F.col("conv_id") % every})
    conversations = conversations.join(first, "base", "left").withColumn("opening", F.slice("opening", F.lit(1), F.col("h")))
    shared = F.when(F.col("opening").isNull(), 0).otherwise(F.size("opening"))
    conversations = conversations.withColumn("shared", shared).withColumn("size", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.join(conversations.select("conv_id", "h", "shared", "size"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("place"), "name", "n_chars", "size"
    )
    put = conversations.select("conv_id", "size", F.inline("opening")).select("conv_id", F.col("place").cast("long"), "name", "n_chars", "size")
    return own.unionByName(put), conversations.select("conv_id", "size")


def _chained(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, depth, block, name, n_chars, size): names of the sequences that begin with the block and end with the turn."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name, blake = None, b"", hashlib.blake2b
        for batch in batches:
            names = []
            for conv, part, turn in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if (conv, part) != last:
                    last, name = (conv, part), b""
                name = blake(name + turn, digest_size=16).digest()
                names.append(name)
            yield pa.record_batch([*batch.columns[:3], pa.array(names, pa.binary()), *batch.columns[4:]], ["conv_id", "depth", "block", "name", "n_chars", "size"])

    dealt = rows.select(
        "conv_id", (F.col("place") + 1).alias("depth"), F.floor(F.col("place") / block).alias("block"), "name",
        F.col("n_chars").cast("long"), F.col("size").cast("long")
    ).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    return dealt.mapInArrow(chain, "conv_id long, depth long, block long, name binary, n_chars long, size long")


def _paths(turns: DataFrame, longest: int, block: int) -> DataFrame:
    """(conv_id, depth, name, n_chars, size): the nodes that every conversation passes, by the digests of their turns."""
    rows = saved(_chained(turns, block))
    if longest <= block:
        return rows.drop("block")
    # the name of a block's first node is that of the last one before it, put before the block's own
    ends = rows.where((F.col("depth") % block == 0) & (F.col("depth") < F.col("size")))
    last = ends.select("conv_id", F.col("block").alias("place"), "name", F.lit(0).alias("n_chars"), "size")
    carried = _chained(last, 1 << 62).select("conv_id", F.col("depth").alias("block"), F.col("name").alias("_before"))
    rows = rows.join(carried, ["conv_id", "block"], "left")
    whole = F.when(F.col("_before").isNull(), F.col("name")).otherwise(_digest("_before", "name"))
    return saved(rows.select("conv_id", "depth", whole.alias("name"), "n_chars", "size"))


def centroid_sums(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values (rows of a 2-d array) over the subtree of each node of a forest, by centroid decomposition.

    ``parent`` is -1 at tops. ``weight`` is that of a node's subtree: positive, and more than its children's together.
    """
    n, sums, weight = len(parent), np.zeros_like(values), weight.copy()
    top = np.where(parent < 0, np.arange(n), parent)
    while (top[top] != top).any():
        top = top[top]
    left, jump, centre = np.arange(n), np.empty(n, np.int64), np.empty(n, np.int64)
    while len(left):
        heavy = left[2 * weight[left] > weight[top[left]]]
        heavy = heavy[np.lexsort((depth[heavy], top[heavy]))]
        c = heavy[np.append(np.flatnonzero(np.diff(top[heavy])), len(heavy) - 1)]
        centre[top[c]] = c
        own, up = centre[top[left]], parent[left]
        below = up == own
        # the parts: what hangs at each child of a centroid, what is above it, and itself
        jump[left] = np.where((left == top[left]) | (left == own) | below, left, up)
        while (jump[jump[left]] != jump[left]).any():
            jump[left] = jump[jump[left]]
        part = jump[left]
        total = np.zeros_like(values)
        np.add.at(total, part, values[left])
        tops = left[below & (part == left)]
        np.add.at(total, parent[tops], total[tops])
        # from the centroid to the top
        at, of = c, c
        sums[at] += total[of]
        while (on := at != top[of]).any():
            at, of = parent[at[on]], of[on]
            sums[at] += total[of]
            weight[at] -= weight[of]
        top[left] = part
        left = left[left != own]
    return sums


#: A node in a component (that of the node top_owner, top_depth), with what is summed and the sums so far.
_NODE = "owner long, depth long, up long, n_convs long, n_children long, weight long, leaf long, saved long, top_owner long, top_depth long, leaves long, total long"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _inside_tasks(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """Adds the sums over subtrees inside each component to ``leaves`` and ``total``."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {k: table[k].to_numpy() for k in _NAMES}
        component = np.cumsum((np.diff(c["top_owner"], prepend=c["top_owner"][0]) != 0) | (np.diff(c["top_depth"], prepend=c["top_depth"][0]) != 0))
        owners, depths = np.unique(np.concatenate([c["owner"], c["up"]])), np.unique(np.concatenate([c["depth"], c["depth"] - 1]))
        place = lambda owner, depth: (component * len(depths) + np.searchsorted(depths, depth)) * len(owners) + np.searchsorted(owners, owner)
        # components are in order, and the nodes of each by depth and owner
        keys, above = place(c["owner"], c["depth"]), place(c["up"], c["depth"] - 1)
        is_top = (c["owner"] == c["top_owner"]) & (c["depth"] == c["top_depth"])
        parent = np.where(is_top, -1, np.searchsorted(keys, above))
        sums = centroid_sums(parent, c["depth"], c["weight"], np.stack([c["leaf"], c["saved"]], 1))
        c["leaves"], c["total"] = c["leaves"] + sums[:, 0], c["total"] + sums[:, 1]
        yield from pa.table(c).to_batches(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= held:
                table = pa.Table.from_batches(waiting).combine_chunks()
                # all but the last component, which may go on
                a, b = table["top_owner"].to_numpy(), table["top_depth"].to_numpy()
                cut = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if (a[0], b[0]) != (a[-1], b[-1]) else 0
                if cut:
                    yield from solve(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
                n = len(table) - cut
        if n:
            yield from solve(pa.Table.from_batches(waiting))

    dealt = nodes.select(*_NAMES).repartition("top_owner", "top_depth").sortWithinPartitions("top_owner", "top_depth", "depth", "owner")
    return dealt.mapInArrow(run, _NODE)


def _by_joins(nodes: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """Splits components of more than ``most`` nodes at their centroids, until there are none; the sums so far go along.

    ``paths`` has (conv_id, depth, owner) of all these nodes, for the conversations that own any.
    """
    nodes, top = saved(nodes), ["top_owner", "top_depth"]
    step = paths.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("owner").alias("next_owner"))
    steps = saved(paths.join(step, ["conv_id", "depth"], "left"))
    while True:
        large = nodes.groupBy(*top).agg(F.count("*").alias("n"), F.max("weight").alias("whole")).where(F.col("n") > most)
        heavy = nodes.join(large, top).where("2 * weight > whole")
        centres = saved(heavy.groupBy(*top).agg(F.max_by(F.struct("owner", "depth", "weight"), "depth").alias("c")))
        if not centres.limit(1).count():
            return nodes
        # what a node's own conversation passes at the centroid's depth tells whether it lies below
        rows = nodes.join(centres, top, "left")
        at = steps.select(F.col("conv_id").alias("owner"), F.col("depth").alias("_depth"), F.col("owner").alias("_passed"), "next_owner")
        rows = rows.withColumn("_depth", F.col("c.depth")).join(at, ["owner", "_depth"], "left")
        below = F.coalesce((F.col("depth") > F.col("c.depth")) & (F.col("_passed") == F.col("c.owner")), F.lit(False))
        itself = F.coalesce((F.col("depth") == F.col("c.depth")) & (F.col("owner") == F.col("c.owner")), F.lit(False))
        rows = rows.withColumns({"_below": below, "_itself": itself})
        # and what the centroid's conversation passes above it is its way to the top
        way = centres.join(steps, F.col("c.owner") == F.col("conv_id")).where(F.col("depth").between(F.col("top_depth"), F.col("c.depth")))
        way = way.select(*top, "owner", "depth", F.lit(True).alias("_way"))
        sums = rows.where("_below or _itself").groupBy(*top).agg(F.sum("leaf").alias("_leaves"), F.sum("saved").alias("_total"))
        rows = rows.join(way, [*top, "owner", "depth"], "left").join(sums, top, "left")
        # a centroid is done: it stays as a component of its own, with nothing left to add
        nodes = saved(
            rows.select(
                "owner", "depth", "up", "n_convs", "n_children",
                F.when(F.col("_way") & ~F.col("_itself"), F.col("weight") - F.col("c.weight")).otherwise(F.col("weight")).alias("weight"),
                *(F.when(F.col("_itself"), 0).otherwise(F.col(k)).alias(k) for k in ("leaf", "saved")),
                F.when(F.col("_itself"), F.col("owner")).when(F.col("_below"), F.col("next_owner")).otherwise(F.col("top_owner")).alias("top_owner"),
                F.when(F.col("_itself"), F.col("depth")).when(F.col("_below"), F.col("c.depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
                (F.col("leaves") + F.coalesce(F.when(F.col("_way"), F.col("_leaves")), F.lit(0))).alias("leaves"),
                (F.col("total") + F.coalesce(F.when(F.col("_way"), F.col("_total")), F.lit(0))).alias("total"),
            )
        )


def _hashed_ids(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of nodes with conversations that end there: their ids in order, comma-joined.

    Ids are put in order and joined in bounded groups; a task hashes a node's groups one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (owner, depth) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (owner, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], ["owner", "depth", "ends_sha256"])
        if node:
            yield pa.record_batch([pa.array([x]) for x in (*node, state.hexdigest())], ["owner", "depth", "ends_sha256"])

    some = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / IDS).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    return some.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK, component: int = COMPONENT) -> DataFrame:
    """One row for each node of the trie of conversations: conv_id (its least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, place, name, n_chars, size), places from 0 without gaps; ``conversations`` (conv_id, size)
    has those without turns, too. The root has depth 0 and a null parent; without conversations there is no node.
    ``n_leaves`` counts the nodes without children in a node's subtree (itself, if it is one), ``saved_tokens`` sums (n_convs - 1) *
    n_chars over it, and ``ends_sha256`` hashes the ids of the members that end at the node.
    """
    conversations = saved(conversations)
    first = conversations.agg(F.min("conv_id"), F.max("size")).first()
    if first[0] is None:
        turns, root, longest = turns.limit(0), 0, 0
    else:
        root, longest = first
    paths = _paths(turns, longest, block)
    # one row a node, written before the rows of all paths are joined, so that Spark can split those of a node that many pass
    nodes = saved(
        paths.groupBy("name").agg(
            F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("size") - F.col("depth") + 1).alias("weight"),
            F.min("n_chars").alias("n_chars"),
        )
    )
    passed = paths.select("conv_id", "depth", "name", "size").join(nodes, "name")
    light, foreign = F.col("weight") < component, F.col("owner") < F.col("conv_id")
    chains = saved(
        passed.groupBy("conv_id").agg(
            F.max(F.when(foreign, F.col("owner"))).alias("from_owner"), F.min(F.when(~foreign, F.col("depth"))).alias("begin"),
            F.min(F.when(light, F.col("owner"))).alias("top_owner"), F.min(F.when(light, F.col("depth"))).alias("top_depth"),
        )
    )
    begun = chains.where("begin is not null").select(
        F.coalesce("from_owner", F.lit(root)).alias("owner"), (F.col("begin") - 1).alias("depth")
    )
    grown = begun.groupBy("owner", "depth").agg(F.count("*").alias("_begun"))
    owned = passed.where(~foreign).join(chains, "conv_id")
    up = F.when(F.col("depth") == F.col("begin"), F.coalesce("from_owner", F.lit(root))).otherwise(F.col("owner"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    inner = owned.select(
        "owner", "depth", up.alias("up"), "n_convs", (F.col("size") > F.col("depth")).cast("long").alias("_next"), "weight",
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"), F.when(light, F.col("top_owner")).otherwise(root).alias("top_owner"),
        F.when(light, F.col("top_depth")).otherwise(0).alias("top_depth"),
    )
    top = conversations.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("size") + 1).alias("weight")).where("n_convs > 0")
    top = top.select(
        "owner", zero.alias("depth"), F.col("owner").alias("up"), "n_convs", zero.alias("_next"), "weight", zero.alias("saved"),
        F.col("owner").alias("top_owner"), zero.alias("top_depth"),
    )
    # a node is a leaf if all its members end there
    every = inner.unionByName(top).join(grown, ["owner", "depth"], "left").select(
        "owner", "depth", "up", "n_convs", (F.col("_next") + F.coalesce("_begun", zero)).alias("n_children"), "weight",
        (F.col("weight") == F.col("n_convs")).cast("long").alias("leaf"), "saved", "top_owner", "top_depth", zero.alias("leaves"), zero.alias("total"),
    )
    every = saved(every)
    is_heavy = (F.col("weight") >= component) | (F.col("depth") == 0)
    low = saved(_inside_tasks(every.where(~is_heavy)))
    # the sums of light components are a part of the heavy nodes that they hang at
    hung = low.where("owner = top_owner and depth = top_depth").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(
        F.sum("leaves").alias("_leaves"), F.sum("total").alias("_total")
    )
    high = every.where(is_heavy).join(hung, ["owner", "depth"], "left").select(
        *(
            (F.col(c) + F.coalesce({"leaf": "_leaves", "saved": "_total"}[c], zero)).alias(c) if c in ("leaf", "saved") else F.col(c) for c in _NAMES
        )
    )
    n_heavy = every.where(is_heavy).count()
    if n_heavy > component:
        owners = every.where(is_heavy).select(F.col("owner").alias("conv_id")).distinct()
        ways = passed.where(~light).select("conv_id", "depth", "owner").join(owners, "conv_id")
        ways = ways.unionByName(owners.select("conv_id", zero.alias("depth"), F.lit(root).cast("long").alias("owner")))
        high = _by_joins(high, ways, component)
    ends = passed.where("depth = size").select("owner", "depth", "conv_id").unionByName(
        conversations.where("size = 0").select(F.lit(root).cast("long").alias("owner"), zero.alias("depth"), "conv_id")
    )
    out = low.unionByName(_inside_tasks(high)).join(_hashed_ids(ends), ["owner", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("up")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("total").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
