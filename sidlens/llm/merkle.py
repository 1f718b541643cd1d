"""A Merkle tree over the rows of a table: a tree for each group of rows, one over the groups' roots, and proofs of rows against the root.

All of it is DataFrame functions. Digests are held as 32 bytes; what is hashed is
their lower-case hex text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import with_index
from .common import dropped, saved

#: Consecutive nodes that become one.
FANOUT = 16
#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the groups' roots; groups have 0, 1, ...
TOP = -1


@dataclass
class Manifest:
    """leaves: (id, leaf, changed, tree, idx, n), n the tree's leaves; levels and top: the nodes (tree, idx, digest, n) of the groups' trees and of the tree over them, from the leaves up, n the level's nodes in that tree; root: its hex text, None without rows."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def digest(*texts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*texts), 256))


def text_of(digests: Column) -> Column:
    """The hex texts of an array of digests, end to end."""
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def grown(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels from the lowest nodes (tree, idx, digest, n) up to the trees' roots; most: the largest n. A tree ends at its one node. A run holds FANOUT nodes at most, and each level is that much smaller than the one below."""
    levels = [nodes]
    while most > 1:
        runs = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest")))["digest"].alias("parts"), F.max("n").alias("n"))
        levels.append(saved(runs.select("tree", "idx", digest(text_of(F.col("parts"))).alias("digest"), F.ceil(F.col("n") / FANOUT).alias("n")), "nodes"))
        most = -(-most // FANOUT)
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    out = None
    for nodes in levels:
        one = nodes.where("n = 1").select("tree", "digest")
        out = one if out is None else out.union(one)
    return out


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", changes: dict[str, Column] | None = None, when: Column | None = None) -> Manifest:
    """The trees of all rows. A leaf is the hash of the row's fields; a group's leaves ascend by `order` (nulls first; equal ones by leaf; rows equal in all are alike), groups by name, null first, bytewise.

    changes: values that replace fields where `when` holds, as tampering would; the
    hash of such a row is `changed`, else null. No group is gathered: rows are dealt
    in ranges of (group, order, leaf) and numbered by what lies before their range.
    """
    hexed = lambda held: digest(*[field(held.get(f, F.col(f))) for f in fields])
    changed = F.when(when, hexed(changes)) if changes else F.lit(None).cast("binary")
    hashed = saved(rows.select(F.col(order).alias("id"), F.col(group).alias("name"), hexed({}).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row")), "hashed")
    by = ("name", "id", "leaf", "row")
    # The number of a row within its range, and above it that of the range.
    dealt = saved(hashed.repartitionByRange(*by).sortWithinPartitions(*by).drop("row").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "dealt")
    dropped(hashed)
    parts = dealt.groupBy("part", "name").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    w = Window.partitionBy("name").orderBy("part")  # a row for each range that holds the group
    parts = parts.withColumn("n", F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("start", F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = saved(parts, "parts")
    trees = with_index(parts.where("start = 0").select("name", "first"), "first", name="tree").select(F.col("name").alias("own"), "tree")
    parts = parts.join(trees, F.col("name").eqNullSafe(F.col("own"))).select(F.col("part").alias("of"), F.col("name").alias("named"), "tree", "n", "start", "first")
    leaves = saved(dealt.join(parts, (F.col("part") == F.col("of")) & F.col("name").eqNullSafe(F.col("named"))).select("id", "leaf", "changed", "tree", (F.col("start") + F.col("at") - F.col("first")).alias("idx"), "n"), "leaves")
    dropped(dealt)
    sizes = leaves.agg(F.max("n").alias("most"), (F.max("tree") + 1).alias("trees")).first()
    if sizes["most"] is None:
        return Manifest(leaves, [], [], None)
    levels = grown(leaves.select("tree", "idx", F.col("leaf").alias("digest"), "n"), sizes["most"])
    top = grown(saved(roots_of(levels).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(sizes["trees"]).alias("n")), "subroots"), sizes["trees"])
    return Manifest(leaves, levels, top, bytes(top[-1].first()["digest"]).hex())


def looked_up(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, run, idx, step, and more of the columns) of each node beside others: step holds its place in its run and the run's other digests, left to right.

    A node explodes its siblings' coordinates, which follow from its index and the
    level's size; they are joined with the node table and put in order. Nodes are
    dealt by run once, before they are exploded, and stay where they are: of the
    join's condition the place within the run is no key.
    """
    run = F.floor(F.col("idx") / FANOUT)
    siblings = F.array_remove(F.sequence(run * FANOUT, F.least((run + 1) * FANOUT, F.col("n")) - 1), F.col("idx"))
    asked = nodes.where("n > 1").select("tree", run.alias("run"), "idx", siblings.alias("siblings"), *more).repartition("tree", "run").withColumn("sibling", F.explode_outer("siblings"))
    held = nodes.select(F.col("tree").alias("of"), run.alias("in"), F.col("idx").alias("at"), "digest").hint("shuffle_hash")
    found = asked.join(held, (F.col("tree") == F.col("of")) & (F.col("run") == F.col("in")) & (F.col("sibling") - F.col("at") == 0), "left")
    step = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("sibling", "digest"))))["digest"]
    found = found.groupBy("tree", "run", "idx").agg(step.alias("siblings"), *[F.first(c).alias(c) for c in more])
    return found.select("tree", "run", "idx", F.struct((F.col("idx") % FANOUT).cast("int").alias("place"), "siblings").alias("step"), *more)


_PATH = "array<struct<place:int,siblings:array<binary>>>"


def upper_paths(levels: list[DataFrame], above: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """((tree, idx, subroot, path) of the nodes of the second level, or None, and of the roots (tree, subroot, path)). A path holds a node's step and those of all nodes above it, the lowest first; above: the path (tree, path) from each tree's root on.

    A parent's path is handed to its children, FANOUT at most: the rows below ask for
    no coordinate near the root, which would be one key of all rows.
    """
    none = F.array().cast(_PATH)
    over = roots_of(levels).withColumnRenamed("digest", "subroot")
    over = over.join(above, "tree").select("tree", "subroot", "path") if above is not None else over.select("tree", "subroot", none.alias("path"))
    over = saved(over, "over")
    paths = None
    for nodes in reversed(levels[1:]):
        tops = nodes.where("n = 1").select("tree", "idx").join(over, "tree").select("tree", "idx", "subroot", "path")
        paths = saved(tops if paths is None else tops.union(handed_down(looked_up(nodes), paths)), "paths")
    return paths, over


def handed_down(steps: DataFrame, parents: DataFrame) -> DataFrame:
    """The columns of steps (tree, run, idx, step, ...), but with subroot and path instead of run and step."""
    up = parents.select("tree", F.col("idx").alias("run"), "subroot", "path")
    more = [c for c in steps.columns if c not in ("tree", "run", "idx", "step")]
    return steps.join(up, ["tree", "run"]).select("tree", "idx", "subroot", F.concat(F.array("step"), "path").alias("path"), *more)


def proofs(m: Manifest) -> DataFrame:
    """(id, leaf, changed, subroot, path) of every row: its proof, from its own siblings to those below the root."""
    top, over = upper_paths(m.top, None)
    # The groups' roots are the leaves of the top.
    above = over.select(F.lit(0).cast("long").alias("tree"), "path") if top is None else handed_down(looked_up(m.top[0]), top).select(F.col("idx").alias("tree"), "path")
    paths, over = upper_paths(m.levels, above)
    out = m.leaves.where("n = 1").join(over, "tree").select("id", "leaf", "changed", "subroot", "path")
    if paths is None:
        return out
    own = looked_up(m.leaves.withColumn("digest", F.col("leaf")), "id", "leaf", "changed")
    return out.union(handed_down(own, paths).select("id", "leaf", "changed", "subroot", "path"))


def siblings_hash(path: Column) -> Column:
    return F.sha2(text_of(F.flatten(F.transform(path, lambda s: s["siblings"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The hex root that a leaf and its path give."""
    part = lambda s, start, n: text_of(F.slice(s["siblings"], start, n))
    return F.aggregate(path, F.lower(F.hex(leaf)), lambda held, s: F.sha2(F.concat(part(s, F.lit(1), s["place"]), held, part(s, s["place"] + 1, F.lit(FANOUT))), 256))


def verified(rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", changes: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Per row: the column `order`, leaf, subroot, root, proof_sha256 (the hash of its proof's digests), all of the rows as they are; folded_root, from the row as it is changed where `when` holds, and the original siblings; verified, whether that is the root.

    Repeated rows count each; a null id or group is a value of its own; empty tables
    give no rows. Columns other than the fields don't count.
    """
    m = manifest(rows, fields, group, order, changes, when)
    if m.root is None:
        kind = rows.schema[order].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{order}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    text = lambda c: F.lower(F.hex(c))
    p = proofs(m).select(F.col("id").alias(order), text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(m.root).alias("root"), siblings_hash(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))
