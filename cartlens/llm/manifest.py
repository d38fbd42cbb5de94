"""Merkle manifest of a table by checkpoint and recompute.

Every row is a leaf, the digest of its columns. The leaves of a group stand in the order of their keys; every `FAN`
consecutive nodes give the node above them, until one is left, and the groups' last nodes form a tree of the same kind.
Only every `KEPT`-th level is stored: an aligned subtree of FAN**KEPT nodes is one row that a few built-in functions
fold to its top. A proof goes the other way. From the top down, the levels between two stored ones are regenerated from
the stored nodes of each subtree, the siblings of every node are emitted with those of its stored ancestor, and the
regenerated nodes are gone with the row. No task holds more than one subtree.

Places of leaves come from range partitioning and one count for each range and group, so a group that holds a third of
all rows is spread over all tasks.

Defined results: a null column counts as `-`, a null group is a group of its own, the first; null keys come first; rows
that repeat a key stand in the order of their leaves, equal rows side by side, and each has its own place; an empty
table has no root and an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.llm.ordered import in_order, placed
from cartlens.llm.shared import written

FAN = 8
#: Levels from one stored level to the next.
KEPT = 3
SUBTREE = FAN**KEPT
PATH = "array<struct<before:string,after:string>>"


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the leaves (first) and of the groups' last nodes, and the root (None without rows)."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(*map(field, columns))


def _height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    out = F.when(n <= 1, 0)
    for level in range(1, 22):
        if FAN**level < 1 << 63:
            out = out.when(n <= FAN**level, level)
    return out.otherwise(21)


def _above(nodes: Column) -> Column:
    """Digests of the runs of `FAN` of an array of nodes."""
    runs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(nodes) / FAN).cast("int") - 1, F.lit(0)))
    return F.transform(runs, lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * FAN + 1, FAN)).cast("binary"), 256))


def _subtrees(nodes: DataFrame, base: int, extra: list[str]) -> DataFrame:
    """One row for each aligned subtree of open nodes (g, idx, h, n): its nodes in order as `l0`, regenerated levels, top."""
    row = F.struct("idx", "h", *extra)
    groups = nodes.where(_height(F.col("n")) > base).groupBy("g", F.floor(F.col("idx") / SUBTREE).alias("c"))
    made = groups.agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("n").alias("n"))
    made = made.withColumns({"open": F.least(F.lit(KEPT), _height(F.col("n")) - base), "l0": F.col("rows.h")})
    for k in range(KEPT):
        nodes_above = F.when(F.col("open") > k, _above(F.col(f"l{k}"))).otherwise(F.col(f"l{k}"))
        # inlined into its uses, a level would be digested again for each of them
        made = made.withColumn(f"l{k + 1}", F.explode(F.array(nodes_above)))
    return made.withColumn("top", F.get(F.col(f"l{KEPT}"), F.lit(0)))


def stored_levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Every KEPT-th level above written nodes (g, idx, h, n), each written; the last of each group is its only node."""
    highest = nodes.agg(F.max(_height(F.col("n")))).first()[0] or 0
    levels = [nodes]
    for base in range(0, highest, KEPT):
        tops = _subtrees(levels[-1], base, []).select("g", F.col("c").alias("idx"), F.col("top").alias("h"), "n")
        levels.append(written(tops, name))
    return levels


def last_nodes(levels: list[DataFrame]) -> DataFrame:
    """(g, h): the one node that remains of each group."""
    found = None
    for k, nodes in enumerate(levels):
        done = nodes.where(_height(F.col("n")) <= k * KEPT).select("g", "h")
        found = done if found is None else found.union(done)
    return found


def paths(levels: list[DataFrame], ended: Callable[[DataFrame], DataFrame], extra: list[str]) -> DataFrame:
    """(g, idx, h, extra, path, subroot) of every node of the first level.

    `ended` gives the last node of each group its path and subroot. `path` has, level by level from the node to the root,
    the siblings before and behind it, each as one text.
    """
    known = None
    for k in reversed(range(len(levels))):
        more = extra if k == 0 else []
        nodes = levels[k]
        done = ended(nodes.where(_height(F.col("n")) <= k * KEPT)).select("g", "idx", "h", *more, "path", "subroot")
        if known is not None:
            trees = _subtrees(nodes, k * KEPT, more)
            own = trees.select("g", "c", F.explode(_siblings(more)).alias("x"))
            above = known.select("g", F.col("idx").alias("c"), F.col("path").alias("upper"), "subroot")
            met = own.join(above, ["g", "c"])
            done = done.union(
                met.select("g", "x.idx", "x.h", *(F.col(f"x.{c}") for c in more), F.concat("x.path", "upper").alias("path"), "subroot")
            )
        known = done
    return known


def _siblings(extra: list[str]) -> Column:
    """For each node of a subtree: idx, h, extra columns and its siblings in the levels below the subtree's top."""

    def one(row: Column, place: Column) -> Column:
        steps = []
        for k in range(KEPT):
            at = F.floor(place / FAN**k).cast("int")
            start = F.floor(at / FAN).cast("int") * FAN
            level = F.col(f"l{k}")
            before = F.concat_ws("", F.slice(level, start + 1, at - start))
            after = F.concat_ws("", F.slice(level, at + 2, start + FAN - 1 - at))
            steps.append(F.struct(before.alias("before"), after.alias("after")))
        path = F.slice(F.array(*steps), F.lit(1), F.col("open"))
        return F.struct(row["idx"].alias("idx"), row["h"].alias("h"), *(row[c].alias(c) for c in extra), path.alias("path"))

    return F.transform("rows", one)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]).cast("binary"), 256))


def build(leaves: DataFrame, key: str, group: str, extra: list[str]) -> Manifest:
    """Manifest of leaves (key, group, h, extra)."""
    g = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, then bytewise
    # written first: cutting ranges reads its input twice, and texts need be digested once
    keyed = written(leaves.select(g.alias("g"), F.col(key).alias("_key"), "h", *extra), "digests")
    order = [F.col("g"), F.col("_key").asc_nulls_first(), F.col("h"), *(F.col(c).asc_nulls_first() for c in extra)]
    nodes = placed(in_order(keyed, order, "leaves"), "g").select("g", "idx", "h", "n", "_key", *extra)
    levels = stored_levels(nodes, "levels")
    groups = last_nodes(levels).select(F.lit("").alias("g"), F.col("g").alias("name"), "h")
    groups = placed(in_order(groups, [F.col("g"), F.col("name")], "groups"), "g").select("g", "idx", "h", "n", "name")
    tops = stored_levels(groups, "tops")
    last = last_nodes(tops).first()
    return Manifest(levels, tops, last["h"] if last else None)


def proofs(made: Manifest, extra: list[str]) -> DataFrame:
    """(_key, h, extra, path, subroot) of every leaf."""
    nothing = {"subroot": F.lit(None).cast("string"), "path": F.array().cast(PATH)}
    tops = paths(made.tops, lambda node: node.withColumns(nothing), ["name"])
    tops = tops.select(F.col("name").alias("g"), F.col("h").alias("subroot"), "path")
    return paths(made.levels, lambda nodes: nodes.join(tops, "g"), ["_key", *extra]).drop("g", "idx")


def verified_manifest(
    df: DataFrame, columns: list[str], key: str, group: str, tampered: Column, changed: dict[str, Column]
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    The manifest is that of df. Each row is then proved by its original siblings; where `tampered` holds, with a leaf of the
    `changed` columns in place of its own.
    """
    leaves = df.select(
        F.col(key), F.col(group), leaf([F.col(c) for c in columns]).alias("h"),
        F.when(tampered, leaf([changed.get(c, F.col(c)) for c in columns])).alias("other"),
    )
    made = build(leaves, key, group, ["other"])
    found = proofs(made, ["other"])
    root = F.lit(made.root).cast("string")
    siblings = F.concat_ws("", F.transform("path", lambda x: F.concat(x["before"], x["after"])))
    return found.select(
        F.col("_key").alias(key), F.col("h").alias("leaf"), "subroot", root.alias("root"), digest(siblings).alias("proof_sha256"),
        fold(F.coalesce("other", "h"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
