"""Parent-child links to full hierarchies (problem 1).

Every patch has at most one parent: the first entry of its ``dependencies`` that names a counted patch of the same
conversation.  A component of that graph is a tree, or one circle with trees hanging from it, and never leaves its
conversation.

* Conversations up to ``block_rows`` rows are co-located whole, which co-locates each of their components, and walked by an
  iterative depth-first traversal with node colours (white, grey, black); an edge to a grey node is the back edge of a
  circle.  One shuffle by conversation serves the choice of counted rows and the traversal; a task holds one conversation at
  a time.
* Larger conversations are split: components are labelled by pointer doubling over their rows, spread by patch, with one
  written table per round; then each component of up to ``block_rows`` nodes is co-located and walked by the same traversal.
  A still larger component keeps the root and depth that doubling found; its paths are built level by level.

Results for the cases named in the tests: null or empty ``dependencies``: no parent; null, blank, dangling entries: passed
over; an entry naming the patch itself makes a circle of one; repeated rows: only the counted row; null ids: left out;
an empty table: an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.scratch import materialize
from memloom.sources.tables import counted, norm_id

#: Rows of a conversation, or nodes of a component, that one task may hold at a time.
BLOCK_ROWS = 200_000
ROWS_PER_TASK = 60_000

SCHEMA = "conv_id BIGINT, patch_id STRING, parent_id STRING, root_id STRING, depth INT, path ARRAY<STRING>, n_descendants BIGINT, on_cycle BOOLEAN"
LINKS = "conv_id BIGINT, patch_id STRING, parent_id STRING, root_id STRING"


def walk(ids: list[str], parent: list[int]) -> tuple[list[int], list[int], list[int], list[str]]:
    """Root index (or -1), depth, position in the finishing order and circle label of each node; parent -1 is none.

    Depth counts edges from the root; nodes of a circle have depth 0, nodes below it their distance to it.
    """
    n = len(ids)
    colour, root, depth, cycle = bytearray(n), [-1] * n, [0] * n, [""] * n
    order: list[int] = []
    for start in range(n):
        if colour[start]:
            continue
        stack, x = [], start
        while x >= 0 and not colour[x]:
            colour[x] = 1
            stack.append(x)
            x = parent[x]
        if x >= 0 and colour[x] == 1:
            ring = stack[stack.index(x) :]
            label = "cycle:" + min(ids[i] for i in ring)
            for i in ring:
                cycle[i] = label
                colour[i] = 2
            order.extend(reversed(ring))
            del stack[len(stack) - len(ring) :]
        for i in reversed(stack):
            p = parent[i]
            if p < 0:
                root[i] = i
            else:
                root[i], depth[i], cycle[i] = root[p], depth[p] + 1, cycle[p]
            colour[i] = 2
            order.append(i)
    return root, depth, order, cycle


def _resolve(ids: list[str], deps: list[list[str | None] | None]) -> list[int]:
    at: dict[str, int] = {}
    for i, x in enumerate(ids):
        key = x.strip(" ").lower()
        if key not in at or x < ids[at[key]]:
            at[key] = i
    parent = []
    for d in deps:
        p = -1
        for x in d or ():
            if x is not None and (p := at.get(x.strip(" ").lower(), -1)) >= 0:
                break
        parent.append(p)
    return parent


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], rest: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal keys in sorted batches, across batch ends."""
    key, held = None, [[] for _ in rest]
    for batch in batches:
        ks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cols = [batch.column(c).to_pylist() for c in rest]
        start = 0
        for i in range(1, len(ks) + 1):
            if i == len(ks) or ks[i] != ks[start]:
                if ks[start] != key:
                    if key is not None:
                        yield key, held
                    key, held = ks[start], [[] for _ in rest]
                for h, c in zip(held, cols, strict=True):
                    h.extend(c[start:i])
                start = i
    if key is not None:
        yield key, held


def _rows(conv: int, ids: list[str], parent: list[int], full: bool, out: dict[str, list]) -> None:
    root, depth, order, cycle = walk(ids, parent)
    if not full:
        for i, p in enumerate(parent):
            if p >= 0:
                out["conv_id"].append(conv)
                out["patch_id"].append(ids[i])
                out["parent_id"].append(ids[p])
                out["root_id"].append(cycle[i] or ids[root[i]])
        return
    below = [0] * len(ids)
    paths: list[list[str] | None] = [None] * len(ids)
    for i in order:
        if parent[i] >= 0 and not (cycle[i] and depth[i] == 0):
            paths[i] = [*paths[parent[i]], ids[i]]
        else:
            paths[i] = [ids[i]]
    for i in reversed(order):
        if parent[i] >= 0 and not (cycle[i] and depth[i] == 0):
            below[parent[i]] += below[i] + 1
    # On a circle each node has all others of its component below it.
    sizes = Counter(cycle)
    for i, c in enumerate(cycle):
        if c and depth[i] == 0:
            below[i] = sizes[c] - 1
    for i, p in enumerate(parent):
        for k, v in (("conv_id", conv), ("patch_id", ids[i]), ("parent_id", ids[p] if p >= 0 else None), ("root_id", cycle[i] or ids[root[i]]), ("depth", depth[i]), ("path", paths[i]), ("n_descendants", below[i]), ("on_cycle", bool(cycle[i]) and depth[i] == 0)):
            out[k].append(v)


def _arrow_schema(full: bool) -> pa.Schema:
    s = [("conv_id", pa.int64()), ("patch_id", pa.string()), ("parent_id", pa.string()), ("root_id", pa.string())]
    if full:
        s += [("depth", pa.int32()), ("path", pa.list_(pa.string())), ("n_descendants", pa.int64()), ("on_cycle", pa.bool_())]
    return pa.schema(s)


def _kernel(keys: list[str], links: bool, full: bool):
    """links: the rows already have a parent_id instead of dependencies."""
    schema = _arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        for key, (ids, deps) in _groups(batches, keys, ["patch_id", "parent_id" if links else "dependencies"]):
            if links:
                at = {x: i for i, x in enumerate(ids)}
                parent = [-1 if d is None else at[d] for d in deps]
            else:
                parent = _resolve(ids, deps)
            _rows(key[0], ids, parent, full, out)
            if len(out["conv_id"]) > 20_000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {f.name: [] for f in schema}
        if out["conv_id"]:
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _hot_links(rows: DataFrame) -> DataFrame:
    """(conv_id, patch_id, parent_id or null) by joins, without gathering a conversation."""
    ids = rows.groupBy("conv_id", norm_id(F.col("patch_id")).alias("dep")).agg(F.min("patch_id").alias("named"))
    first = (
        rows.select("conv_id", "patch_id", F.posexplode("dependencies").alias("pos", "dep"))
        .withColumn("dep", norm_id(F.col("dep")))
        .join(ids, ["conv_id", "dep"])
        .groupBy("conv_id", "patch_id")
        .agg(F.min(F.struct("pos", "named")).alias("m"))
        .select("conv_id", "patch_id", F.col("m.named").alias("parent_id"))
    )
    return rows.select("conv_id", "patch_id").join(first, ["conv_id", "patch_id"], "left")


def double(links: DataFrame) -> DataFrame:
    """Pointer doubling: root_id and comp (the root, or the least id of the circle) of each node.

    Round r knows the node 2^r steps up.  Chains that reach a root are done; a round in which none more get done leaves
    only chains that end in circles, and these are followed until the steps cover all of them.
    """
    state = materialize(links.select("conv_id", "patch_id", F.coalesce("parent_id", "patch_id").alias("up"), F.col("parent_id").isNull().alias("done"), F.col("patch_id").alias("least"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("steps")), "double")
    left, reach = None, 1
    while True:
        now = state.where("NOT done").count()
        if not now or (now == left and reach >= 2 * now):
            break
        left = now
        open_ = state.where("NOT done")
        up = state.select("conv_id", F.col("patch_id").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"), F.col("least").alias("least2"), F.col("steps").alias("steps2"))
        stepped = open_.join(up, ["conv_id", "up"]).select("conv_id", "patch_id", F.col("up2").alias("up"), F.col("done2").alias("done"), F.least("least", "least2").alias("least"), (F.col("steps") + F.col("steps2")).alias("steps"))
        state = materialize(state.where("done").unionByName(stepped), "double")
        reach *= 2
    ends = state.where("NOT done").select("conv_id", "up").distinct()
    ring = state.where("NOT done").join(ends.withColumnRenamed("up", "patch_id"), ["conv_id", "patch_id"]).select("conv_id", F.col("patch_id").alias("up"), F.col("least").alias("ring"))
    return (
        state.join(ring, ["conv_id", "up"], "left")
        .select("conv_id", "patch_id", F.when(F.col("done"), F.col("up")).otherwise(F.concat(F.lit("cycle:"), "ring")).alias("root_id"), F.when(F.col("done"), F.col("steps")).alias("depth"))
    )


def _giant(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Full rows of components too large for a task: paths by doubling of path pieces, descendants from the paths."""
    nodes = links.join(roots, ["conv_id", "patch_id"])
    ring = nodes.where("root_id LIKE 'cycle:%'").select("conv_id", "patch_id", "parent_id")
    # A node of a circle is one that a walk along parents meets again: drop leaves until none are left.
    while not ring.isEmpty():
        n = ring.count()
        ring = materialize(ring.join(ring.select("conv_id", F.col("parent_id").alias("patch_id")).distinct(), ["conv_id", "patch_id"], "left_semi"), "ring")
        if ring.count() == n:
            break
    on = ring.select("conv_id", "patch_id", F.lit(True).alias("on_cycle"))
    level = nodes.join(on, ["conv_id", "patch_id"], "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))
    level = materialize(level, "giant")
    front = level.where("parent_id IS NULL OR on_cycle").select("conv_id", "patch_id", F.lit(0).alias("depth"), F.array("patch_id").alias("path"))
    inner = level.where("parent_id IS NOT NULL AND NOT on_cycle")
    done = front
    while not front.isEmpty():
        front = materialize(
            inner.join(front.select("conv_id", F.col("patch_id").alias("parent_id"), "depth", "path"), ["conv_id", "parent_id"]).select("conv_id", "patch_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("patch_id")).alias("path")), "level"
        )
        done = done.unionByName(front)
    below = done.select("conv_id", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("patch_id")).groupBy("conv_id", "patch_id").agg(F.count("*").alias("n_descendants"))
    others = level.groupBy("conv_id", "root_id").agg((F.count("*") - 1).alias("others"))
    return (
        level.drop("depth")
        .join(done, ["conv_id", "patch_id"])
        .join(below, ["conv_id", "patch_id"], "left")
        .join(others, ["conv_id", "root_id"])
        .select("conv_id", "patch_id", "parent_id", "root_id", F.col("depth").cast("int").alias("depth"), "path", F.when(F.col("on_cycle"), F.col("others")).otherwise(F.coalesce("n_descendants", F.lit(0))).alias("n_descendants"), "on_cycle")
    )


def _hierarchy(patches: DataFrame, full: bool, block_rows: int) -> DataFrame:
    spark = patches.sparkSession
    sizes = patches.where("conv_id IS NOT NULL").groupBy("conv_id").count()
    total, hot = sizes.agg(F.sum("count"), F.collect_list(F.when(F.col("count") > block_rows, F.col("conv_id")))).first()
    # hot has at most total / block_rows members.
    n = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // ROWS_PER_TASK))
    rows = patches.where(~F.col("conv_id").isin(hot)) if hot else patches
    rows = counted(rows.select("conv_id", "patch_id", "dependencies", "ingested_at", "row_id").repartition(n, "conv_id"), "dependencies")
    schema = SCHEMA if full else LINKS
    out = rows.sortWithinPartitions("conv_id").mapInArrow(_kernel(["conv_id"], False, full), schema)
    if not hot:
        return out
    links = materialize(_hot_links(counted(patches.where(F.col("conv_id").isin(hot)), "dependencies")), "links")
    roots = materialize(double(links), "roots")
    if not full:
        return out.unionByName(links.where("parent_id IS NOT NULL").join(roots.drop("depth"), ["conv_id", "patch_id"]))
    comps = roots.groupBy("conv_id", "root_id").agg((F.count("*") <= block_rows).alias("fits"))
    labelled = links.join(roots, ["conv_id", "patch_id"]).join(comps, ["conv_id", "root_id"])
    small = labelled.where("fits").select("conv_id", "root_id", "patch_id", "parent_id").repartition(n, "conv_id", "root_id").sortWithinPartitions("conv_id", "root_id")
    out = out.unionByName(small.mapInArrow(_kernel(["conv_id", "root_id"], True, True), schema))
    large = materialize(labelled.where("NOT fits").select("conv_id", "patch_id", "parent_id", "root_id", "depth"), "large")
    if not large.isEmpty():
        out = out.unionByName(_giant(large.select("conv_id", "patch_id", "parent_id"), large.select("conv_id", "patch_id", "root_id")))
    return out


def hierarchy(patches: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per counted patch: parent, root, depth, path from the root (or from the circle), number of dependents.

    Those of a node of a circle are all others of its component: the rest of the circle and the trees below it.  ``root_id`` is ``cycle:`` and the least id of the circle where the chain of parents ends in one.
    """
    return _hierarchy(patches, True, block_rows)


def _places(rings: DataFrame) -> DataFrame:
    """(conv_id, root_id, ancestor_id, place, size): nodes of circles numbered along their parents."""
    schema = pa.schema([("conv_id", pa.int64()), ("root_id", pa.string()), ("ancestor_id", pa.string()), ("place", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, root), (ids, parents) in _groups(batches, ["conv_id", "root_id"], ["patch_id", "parent_id"]):
            up, n = dict(zip(ids, parents, strict=True)), len(ids)
            ring = [ids[0]]
            while len(ring) < n:
                ring.append(up[ring[-1]])
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array([root] * n), pa.array(ring), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32())], schema=schema)

    rows = rings.select("conv_id", "root_id", "patch_id", "parent_id").repartition("conv_id", "root_id").sortWithinPartitions("conv_id", "root_id")
    return rows.mapInArrow(run, "conv_id BIGINT, root_id STRING, ancestor_id STRING, place INT, size INT")


def descendants(tree: DataFrame) -> DataFrame:
    """(conv_id, ancestor_id, patch_id, distance) for all pairs of a patch and another that its chain of parents meets.

    A chain that ends in a circle meets all nodes of the circle, so these are the ancestors of each other and of all below.
    """
    tree = materialize(tree.select("conv_id", "patch_id", "parent_id", "root_id", "depth", "path", "on_cycle"), "tree")
    on_path = tree.select("conv_id", "patch_id", "depth", F.posexplode("path").alias("pos", "ancestor_id")).where("pos < depth").select("conv_id", "ancestor_id", "patch_id", (F.col("depth") - F.col("pos")).alias("distance"))
    places = materialize(_places(tree.where("on_cycle")), "places").where("size > 1")
    entry = places.select("conv_id", "root_id", F.col("ancestor_id").alias("entry_id"), F.col("place").alias("start"))
    ends = tree.where("root_id LIKE 'cycle:%'").select("conv_id", "root_id", "patch_id", "depth", F.col("path")[0].alias("entry_id")).join(entry, ["conv_id", "root_id", "entry_id"])
    round_ = ends.join(places, ["conv_id", "root_id"]).where("ancestor_id <> entry_id").select("conv_id", "ancestor_id", "patch_id", (F.col("depth") + F.pmod(F.col("place") - F.col("start"), F.col("size"))).alias("distance"))
    return on_path.unionByName(round_)


def found(patches: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, patch_id, root_id) of each counted patch that has a parent."""
    return _hierarchy(patches, False, block_rows).select("conv_id", "patch_id", "root_id")
