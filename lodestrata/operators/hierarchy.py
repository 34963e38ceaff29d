"""Full hierarchies from parent-child rows: root, depth, path and descendants of every node.

Every node has two elements in the Euler tour of its tree: its key with a 0 when the tour enters it
and with a 1 when it leaves it. Each element knows the one that follows (first child, next sibling or
the parent's exit), so a tree is a linked list and a parallel list ranking numbers it; the entry
and exit numbers of a node enclose those of its descendants.

Leaves are peeled before the ranking: a leaf's exit is folded into its entry. Peeling on, round by
round, until only cycles are left would take as many Spark jobs as the longest chain has links.
The ranking itself exposes cycles instead: a component with a cycle has no root, hence no list
head, and its tour falls into two closed circles. An edge has its two elements on different
circles exactly if it lies on the cycle.

List ranking contracts by random mates: in each round an element that drew tails and whose
predecessor drew heads is spliced out (about a quarter of all, each with its distance), until no
more are left than an ordinary task holds, that is all elements over the number of partitions; these
are ranked by pointer doubling and the rounds are undone in reverse. The rounds grow with the
logarithm of the partitions, the work over all rounds is a geometric sum, linear in the nodes.

Keys are the first 15 bytes of the id's SHA-256, so a parent's key is known without a join: no step
meets the children of a parent, or the roots, in one task. Siblings are linked in two levels, first
within (parent, salt), then from group to group; a root's name goes back to its tree by a join that
treats trees larger than a task's share apart.

Defined results: ids are compared as given by the caller; a null child is no row; of several rows
of one child the one with the greatest version counts (ties: the greater parent); a null parent
makes a root; repeated rows collapse; an empty input gives an empty result; a node that is its own
parent is a cycle of one. On a cycle or below one, `depth` is -1, the root is the smallest id on
the cycle, `path` is empty and the interval is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestrata.operators.joins import counted, lookup_hot, partitions_of
from lodestrata.storage import Workspace

_RANKS = "id binary, face binary, pos long, depth long, circle boolean"
_ELEMENT = ["id", "nxt", "w", "d", "head"]
FEWEST = 1_000  # elements below which another round costs more than it spares


def node_key(c: Column | str) -> Column:
    """The 15 bytes that stand for an id; 120 bits never meet by chance."""
    return F.unhex(F.substring(F.sha2(F.col(c) if isinstance(c, str) else c, 256), 1, 30))


def _enter(nid: Column) -> Column:
    return F.concat(nid, F.unhex(F.lit("00")))


def _leave(nid: Column) -> Column:
    return F.concat(nid, F.unhex(F.lit("01")))


def _rank_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks the lists that are left, by pointer doubling along the predecessors."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values("id", ignore_index=True)
    n = len(rows)
    has = np.flatnonzero(rows["nxt"].notna().to_numpy())
    follower = pd.Index(rows["id"]).get_indexer(rows["nxt"].iloc[has])
    back = np.arange(n)
    back[follower] = has
    pos, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pos[follower], depth[follower] = rows["w"].to_numpy(np.int64)[has], rows["d"].to_numpy(np.int64)[has]
    head = np.ones(n, bool)
    head[follower] = False
    least = np.arange(n)
    for _ in range(int(n).bit_length() + 1):
        pos, depth, least = pos + pos[back], depth + depth[back], np.minimum(least, least[back])
        back = back[back]
    circle = ~head[back]
    ids = rows["id"].to_numpy()
    yield pd.DataFrame({"id": ids, "face": ids[np.where(circle, least, back)], "pos": pos, "depth": depth, "circle": circle})


def rank_lists(work: Workspace, elements: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, face, pos, depth, circle) of every element of linked lists (id, nxt, w, d, head).

    `face` is the head of the element's list, or the least element of its circle; `pos` and `depth`
    are the sums of w and d from the head. Ids are unique, an element follows one other at most, and
    `head` says that it follows none. A list or circle that has shrunk to one element is set aside.
    Contraction ends at `limit` elements; without one, at an even share of all elements over the
    session's partitions (`FEWEST` at least), so the last step's task is no larger than any other.
    """
    c = F.col
    done = (c("head") & c("nxt").isNull()) | c("nxt").eqNullSafe(c("id"))
    seen = Observation()
    live = work.cut(elements.select(*_ELEMENT).observe(seen, F.count(F.lit(1)).alias("n")), "elements")
    left = seen.get["n"]
    least = max(FEWEST, left // partitions_of(live)) if limit is None else limit
    rounds: list[DataFrame] = []
    single = None
    while left > least:
        n = len(rounds)
        drew_heads = lambda x: F.xxhash64(x, F.lit(n)).bitwiseAND(1) == 1
        mates = drew_heads(c("id")) & c("nxt").isNotNull() & ~drew_heads(c("nxt"))
        mate = live.where(mates).select(c("id").alias("a"), c("nxt").alias("e"), c("w").alias("aw"), c("d").alias("ad"), c("head").alias("ahead"))
        met = live.where(~drew_heads(c("id"))).join(mate, c("id") == c("e"), "left")
        row = lambda gone, *of: F.struct(*[x.alias(n) for x, n in zip(of, _ELEMENT)], F.lit(gone).alias("gone"))
        spliced = F.array(
            row(False, c("a"), c("nxt"), c("w") + c("aw"), c("d") + c("ad"), c("ahead")),  # the predecessor skips over it
            row(True, c("id"), c("a"), c("aw"), c("ad"), c("head")),  # how far it is behind its predecessor
        )
        stays = F.array(row(False, *map(c, _ELEMENT)))
        met = met.select(F.inline(F.when(c("a").isNotNull(), spliced).otherwise(stays)))
        rest = live.where(drew_heads(c("id")) & ~mates).select(*_ELEMENT, F.lit(False).alias("gone"))
        kind = F.when(c("gone"), f"gone{n}").when(done, "done").otherwise(f"live{n}")
        seen = Observation()
        both = met.unionByName(rest).select(*_ELEMENT, kind.alias("kind")).observe(seen, F.count_if(c("kind") == f"live{n}").alias("n"))
        before, (live, gone, single) = live, work.cut_by(both, "rounds", "kind", [f"live{n}", f"gone{n}", "done"])
        left = seen.get["n"]
        work.drop(before)
        rounds.append(gone)
    ranked = work.add(live.coalesce(1).mapInPandas(_rank_rest, _RANKS), "ranked")  # one task's share at most, see above
    work.drop(live)
    if single is not None:
        zero = F.lit(0).cast("long")
        ranked = work.add(single.select("id", c("id").alias("face"), zero.alias("pos"), zero.alias("depth"), c("nxt").isNotNull().alias("circle")), "ranked")
    for gone in reversed(rounds):
        before = gone.select(c("id").alias("e"), c("nxt").alias("a"), "w", "d").join(ranked, c("a") == c("id"))
        ranked = work.add(before.select(c("e").alias("id"), "face", (c("pos") + c("w")).alias("pos"), (c("depth") + c("d")).alias("depth"), "circle"), "ranked")
        work.drop(gone)
    return ranked


def _tour(edges: DataFrame) -> DataFrame:
    """The elements of the Euler tours of (nid, pid), leaves already peeled; a null pid is a root.

    Siblings are linked within (parent, salt), then the first and last of each group from salt to
    salt: a parent with a third of all nodes is as many groups as there are partitions.
    """
    salts = partitions_of(edges)
    rows = edges.where("pid is not null").withColumn("salt", F.pmod(F.xxhash64("nid"), F.lit(salts)).cast("int"))
    group = W.partitionBy("pid", "salt").orderBy("nid")
    rows = rows.select("*", F.lead("nid").over(group).alias("after"), F.lag("nid").over(group).isNull().alias("first"))
    rows = rows.withColumn("level", F.when(F.col("first") | F.col("after").isNull(), -1).otherwise(F.col("salt")))
    borders = W.partitionBy("pid", "level").orderBy("salt", "nid")
    sibling = F.coalesce("after", F.lead("nid").over(borders))
    links = rows.select("nid", "pid", sibling.alias("sibling"), ((F.col("level") == -1) & F.lag("nid").over(borders).isNull()).alias("starts"))
    said = lambda nid, pid, sib, child: F.struct(nid.alias("nid"), pid.alias("pid"), sib.alias("sibling"), child.alias("child"))
    none, c = F.lit(None).cast("binary"), F.col
    both = F.array(said(c("nid"), c("pid"), c("sibling"), none), said(c("pid"), none, none, c("nid")))
    known = links.select(F.inline(F.when(c("starts"), both).otherwise(F.slice(both, 1, 1))))
    known = known.unionByName(edges.where("pid is null").select("nid", "pid", none.alias("sibling"), none.alias("child")))
    nodes = known.groupBy("nid").agg(*[F.max(n).alias(n) for n in ("pid", "sibling", "child")])
    root, last = c("pid").isNull(), c("sibling").isNull()
    after = F.when(~root & last, _leave(c("pid"))).when(~root, _enter(c("sibling")))
    down = F.when(~root & last, -1).otherwise(0)
    element = lambda i, n, w, d, head: F.struct(i.alias("id"), n.alias("nxt"), F.lit(w).cast("long").alias("w"), d.cast("long").alias("d"), head.alias("head"))
    leaf = F.array(element(_enter(c("nid")), after, 2, down, root))
    inner = F.array(element(_enter(c("nid")), _enter(c("child")), 1, F.lit(1), root), element(_leave(c("nid")), after, 1, down, F.lit(False)))
    return nodes.select(F.inline(F.when(c("child").isNull(), leaf).otherwise(inner)))


def _visits(work: Workspace, rows: DataFrame, nodes: DataFrame | None, limit: int | None) -> DataFrame:
    """(node, face, other, entry, exit, depth, circle) of every node, written.

    `rows`: (child, parent, version). One shuffle of the ids builds the node table: a row counts for
    its child with the version, and for its parent without; hot parents are combined on the map side.
    """
    seen = rows.select(
        F.inline(
            F.array(
                F.struct(F.col("child").alias("node"), F.struct("version", "parent").alias("row")),
                F.struct(F.col("parent").alias("node"), F.lit(None).alias("row")),
            )
        )
    )
    if nodes is not None:
        seen = seen.unionByName(nodes.select(F.col("node"), F.lit(None).cast(seen.schema["row"].dataType).alias("row")))
    names = seen.where("node is not null").groupBy("node").agg(F.max("row").alias("row"))
    names = work.cut(names.select(node_key("node").alias("nid"), "node", node_key("row.parent").alias("pid")), "names")
    ranked = rank_lists(work, _tour(names.select("nid", "pid")), limit)
    enters = F.substring("id", 16, 1) == F.unhex(F.lit("00"))
    of = lambda name, when: F.max(F.when(when, F.col(name)))
    visits = ranked.groupBy(F.substring("id", 1, 15).alias("nid")).agg(
        of("face", enters).alias("face"),
        of("face", ~enters).alias("other"),
        of("pos", enters).alias("entry"),
        of("pos", ~enters).alias("exit"),
        of("depth", enters).alias("depth"),
        F.max("circle").alias("circle"),
    )
    visits = visits.select(
        "nid", "face", F.coalesce("other", "face").alias("other"), "entry", F.coalesce("exit", F.col("entry") + 1).alias("exit"), "depth", "circle"
    )
    return work.cut(names.select("nid", "node").join(visits, "nid").drop("nid"), "visits")


def _with_roots(visits: DataFrame) -> DataFrame:
    """Adds root_id: the node at the head of the list, or the smallest id on the cycle."""
    size = F.floor((F.col("exit") - F.col("entry")) / 2) + 1
    heads = visits.where("not circle and depth = 0").select("face", F.col("node").alias("root_id"), size.alias("size"))
    loops = visits.where("circle and face <> other").groupBy("face", "other").agg(F.min("node").alias("root_id"))
    loops = loops.select(F.inline(F.array(F.struct("face", "root_id"), F.struct(F.col("other").alias("face"), "root_id"))))
    loops = loops.join(counted(visits.where("circle"), "face"), "face")
    return lookup_hot(visits, heads.unionByName(loops), "face")


def hierarchy(rows: DataFrame, nodes: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(node_id, root_id, depth, entry, exit, n_descendants) of every node of (child, parent, version) rows.

    The descendants of a node are the nodes of the same root whose entry lies between its entry and
    exit. `nodes` (node) adds nodes without rows; `limit` is that of `rank_lists`.
    """
    work = Workspace(rows.sparkSession, "hierarchy")
    full = _with_roots(_visits(work, rows, nodes, limit))
    flat = ~F.col("circle")
    return full.select(
        F.col("node").alias("node_id"),
        "root_id",
        F.when(flat, F.col("depth")).otherwise(-1).cast("int").alias("depth"),
        F.when(flat, F.col("entry")).alias("entry"),
        F.when(flat, F.col("exit")).alias("exit"),
        F.when(flat, F.floor((F.col("exit") - F.col("entry")) / 2)).cast("long").alias("n_descendants"),
    )


def _stack_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes in order of entry: the stack of open intervals is the path. Every part brings its own start of the stack."""
    open_: list[tuple[bytes, int, str]] = []
    at = None
    for batch in batches:
        out = []
        for part, face, exit_, node, given in zip(*[batch[c].tolist() for c in ("part", "face", "exit", "node", "given")]):
            if part != at:
                open_, at = [], part
            while open_ and (open_[-1][0] != face or open_[-1][1] < exit_):
                open_.pop()
            open_.append((face, exit_, node))
            if not given:
                out.append((node, [x[2] for x in open_]))
        yield pd.DataFrame(out, columns=["node_id", "path"])


def _bounds_inside(faces: list[bytes], entries: list[int]):
    """A column function: which of the partitions' first entries, sorted, lie strictly inside (entry, exit) of a tree.

    Two binary searches a row, as [low, high) of the sorted bounds; a row is never met with all bounds.
    """
    trees = pd.Index(sorted(set(faces)), dtype=object)
    stride = max(entries) + 2
    keys = trees.get_indexer(faces).astype(np.int64) * stride + np.array(entries, np.int64)

    @F.pandas_udf(StructType([StructField("low", IntegerType()), StructField("high", IntegerType())]))
    def inside(face: pd.Series, entry: pd.Series, exit_: pd.Series) -> pd.DataFrame:
        tree = trees.get_indexer(face)
        base = tree.astype(np.int64) * stride
        low = np.searchsorted(keys, base + np.minimum(entry.to_numpy(np.int64), stride - 1), "right")
        high = np.searchsorted(keys, base + np.minimum(exit_.to_numpy(np.int64), stride - 1), "left")
        high = np.where(tree >= 0, np.maximum(low, high), low)
        return pd.DataFrame({"low": low.astype(np.int32), "high": high.astype(np.int32)})

    return inside


def paths(rows: DataFrame, nodes: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(node_id, root_id, depth, path): the ids from the root down to the node; empty on or below a cycle.

    Nodes are range-sorted by (tree, entry). A scan of that order keeps the open intervals on a
    stack; each partition starts with the ancestors of its first node, found by a binary search of
    every interval among the partitions' first entries. The size of the result is the sum of all
    depths; nothing is shortened.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "paths")
    visits = _visits(work, rows, nodes, limit)
    flat = visits.where("not circle").select("face", "entry", "exit", "node")
    laid = work.cut(flat.repartitionByRange("face", "entry").withColumn("part", F.spark_partition_id()), "laid")
    firsts = laid.groupBy("part").agg(F.min(F.struct("face", "entry")).alias("f")).select("part", "f.*")
    bounds = [(r.part, bytes(r.face), r.entry) for r in firsts.collect()]
    carried = None
    if bounds:
        order = sorted((face, entry, part) for part, face, entry in bounds)
        inside = _bounds_inside([x[0] for x in order], [x[1] for x in order])
        over = laid.withColumn("_in", inside("face", "entry", "exit")).where("_in.low < _in.high")
        parts = F.array(*[F.lit(x[2]) for x in order])
        to = F.explode(F.slice(parts, F.col("_in.low") + 1, F.col("_in.high") - F.col("_in.low"))).alias("part")
        carried = over.select(to, "face", "entry", "exit", "node", F.lit(True).alias("given"))
    own = laid.select("part", "face", "entry", "exit", "node", F.lit(False).alias("given"))
    every = own if carried is None else own.unionByName(carried)
    n = max(1, len(bounds))
    ordered = every.repartition(n, "part").sortWithinPartitions("part", "face", "entry")
    made = ordered.select("part", "face", "exit", "node", "given").mapInPandas(_stack_paths, "node_id string, path array<string>")
    cyclic = _with_roots(visits).where("circle").select(F.col("node").alias("node_id"), "root_id", F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path"))
    made = made.select("node_id", F.col("path")[0].alias("root_id"), (F.size("path") - 1).alias("depth"), "path")
    return made.unionByName(cyclic)


def descendants(path_rows: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) from the rows of `paths`, without the node itself."""
    above = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    at = path_rows.select("node_id", "depth", F.posexplode(above).alias("i", "ancestor_id"))
    return at.select("ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("i")).alias("distance"))
