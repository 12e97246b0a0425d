"""A Merkle manifest of a dataset: a tree per group, a tree over the groups' roots, and each row's proof checked against it."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts

FAN_OUT = 8
#: Levels of a superblock: the 4,096 leaves under one node are hashed in one task.
SUPERBLOCK_LEVELS = 4
#: Tables of a row for each part of a sorted table are broadcast up to so many rows (of under 200 bytes).
BROADCAST_PARTS = 100_000


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the values in turn: - for null, else the bytes of the value as text, a colon, and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def numbered(rows: DataFrame, group: str, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """rows with pos and width long: the place (from 0) in its group, and the rows of the group.

    Rows are sorted over all tasks by group and order; a group is counted by the parts of the table it lies in, so it
    can span any number of tasks. Equal rows are parted by where they were read, so that they don't meet in one task.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("mk_tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(parts(spark), group, *order, "mk_tie").sortWithinPartitions(group, *order, "mk_tie").drop("mk_tie")
    placed = scratch.keep(placed.withColumns({"mk_part": F.spark_partition_id(), "mk_at": F.monotonically_increasing_id()}))
    each = placed.groupBy(group, "mk_part").agg(F.min("mk_at").alias("mk_first"), F.count(F.lit(1)).alias("mk_n"))
    by_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("mk_n").over(by_group.orderBy("mk_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = scratch.keep(each.select(group, "mk_part", (before - F.col("mk_first")).alias("mk_shift"), F.sum("mk_n").over(by_group).alias("width")))
    if each.count() <= BROADCAST_PARTS:
        each = F.broadcast(each)
    return placed.join(each, [group, "mk_part"]).withColumn("pos", F.col("mk_at") + F.col("mk_shift")).drop("mk_part", "mk_at", "mk_shift")


def raised(nodes: list[str]) -> list[str]:
    """The nodes one level up."""
    return [hashlib.sha256("".join(nodes[i : i + FAN_OUT]).encode()).hexdigest() for i in range(0, len(nodes), FAN_OUT)]


def local_levels(leaves: list[str], width: int, levels: int) -> list[list[str]]:
    """The levels of nodes over the leaves of a superblock: up to one node if it has all leaves of its group, else `levels`."""
    out = [leaves]
    while len(out[-1]) > 1 if width <= FAN_OUT**levels else len(out) <= levels:
        out.append(raised(out[-1]))
    return out


def outer_tree(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, pos, top, path) of nodes (grp, pos, node, width): the root of the node's group and the way to it.

    path: from the node up, an element for each level: own int, the node's place in its run, and run string, the nodes of
    the run in a row. Levels are built bottom up, a run at a time; ways are handed down from each node to its at most
    eight children, so no join meets a key with more rows than that.
    """
    levels, now = [], nodes.select("grp", "pos", "node", "width")
    while True:
        now = scratch.keep(now)
        levels.append(now)
        if now.where("width > 1").isEmpty():
            break
        run = F.array_sort(F.collect_list(F.struct("pos", "node")))
        up = now.where("width > 1").groupBy("grp", F.expr(f"pos div {FAN_OUT}").alias("pos"), F.expr(f"(width + {FAN_OUT - 1}) div {FAN_OUT}").alias("width"))
        up = up.agg(F.array_join(F.transform(run, lambda x: x["node"]), "").alias("run"))
        now = up.select("grp", "pos", F.sha2(F.col("run").cast("binary"), 256).alias("node"), "width", "run")
    path = "array<struct<own int, run string>>"
    out = None
    for level in reversed(levels):
        tops = level.where("width = 1").select("grp", "pos", F.col("node").alias("top"), F.array().cast(path).alias("path"))
        if out is None:
            out = tops
        else:
            step = F.struct(F.expr(f"cast(pos % {FAN_OUT} as int)").alias("own"), F.col("run"))
            child = level.where("width > 1").select("grp", F.expr(f"pos div {FAN_OUT}").alias("parent"), "pos").join(
                above.join(out, ["grp", "pos"]).select("grp", F.col("pos").alias("parent"), "run", "top", F.col("path").alias("rest")), ["grp", "parent"])
            out = tops.union(child.select("grp", "pos", "top", F.concat(F.array(step), "rest").cast(path).alias("path")))
        above = level
    return scratch.keep(out)


def reduced(key: tuple, pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The node over one superblock."""
    leaves = [x.hex() for x in pdf.sort_values("pos")["leaf"]]
    width = int(pdf["width"].iloc[0])
    return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "node": [local_levels(leaves, width, levels)[-1][0]], "width": [-(-width // FAN_OUT**levels)]})


def finished(key: tuple, pdf: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proofs and folded roots of the leaves of one superblock, joined with the outer nodes that it needs."""
    pdf = pdf.sort_values("pos")
    outer = outer.iloc[0]
    leaves = [x.hex() for x in pdf["leaf"]]
    local = local_levels(leaves, int(pdf["width"].iloc[0]), levels)
    runs = [["".join(level[i : i + FAN_OUT]) for i in range(0, len(level), FAN_OUT)] for level in local[:-1]]
    far = [(64 * int(x["own"]), x["run"]) for x in [*outer["path"], *outer["root_path"]]]
    beyond = "".join(run[:at] + run[at + 64 :] for at, run in far)
    proofs, folded = [], []
    for i, (leaf, other) in enumerate(zip(leaves, pdf["tampered"])):
        node, siblings, at = other.hex() if other is not None else leaf, [], i
        for level in runs:
            run, own = level[at // FAN_OUT], 64 * (at % FAN_OUT)
            siblings += [run[:own], run[own + 64 :]]
            node = hashlib.sha256(f"{run[:own]}{node}{run[own + 64:]}".encode()).hexdigest()
            at //= FAN_OUT
        for own, run in far:
            node = hashlib.sha256(f"{run[:own]}{node}{run[own + 64:]}".encode()).hexdigest()
        proofs.append("".join(siblings) + beyond)
        folded.append(node)
    out = pd.DataFrame({"id": pdf["id"], "grp": key[0], "pos": pdf["pos"], "leaf": leaves})
    out["subroot"], out["root"], out["proof"], out["folded_root"] = outer["subroot"], outer["root"], proofs, folded
    return out


def merkle_manifest(docs: DataFrame, leaf_cols: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", tampered: Mapping[str, Column] | None = None, levels: int = SUPERBLOCK_LEVELS) -> DataFrame:
    """A row of docs is a leaf: SHA-256 of its leaf_cols (- for null, else bytes, colon, value).

    In each group, leaves ascend by id (null first; then by digest, so equal ids have an order and equal rows may change
    places); while several nodes remain, each 8 in a row, or the last fewer, become the hash of their hexadecimal digests.
    What remains, a lone leaf itself, is the group's subroot; subroots in the order of the groups (null first, then bytewise)
    give the root likewise. tampered: other values of columns, as if changed after the manifest was made; null values of
    the dictionary's columns count as values. Null and empty texts are values, texts count whole, equal rows are leaves of their own, an
    empty table gives no rows. Columns beyond those named play no part, whatever their names.

    Superblocks of 8^levels leaves are reduced first; the tree above them is built from their nodes; then each superblock's
    leaves meet the outer nodes that their proofs need, once.

    Returns for each row: id_col, leaf, subroot, root, proof string (the digests beside the way from the leaf to the root, level
    by level, left to right, 64 digits each), folded_root (from the tampered leaf, if that differs, and the proof), verified
    boolean, and merkle_group string and position long (from 0, in the group).
    """
    scratch = Scratch(docs.sparkSession)
    values = {c: F.col(f"`{c}`") for c in leaf_cols}
    leaf = leaf_hash(list(values.values()))
    other = leaf_hash([(tampered or {}).get(c, v) for c, v in values.items()]) if tampered else F.lit(None).cast("string")
    grp = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit(""))  # null sorts first
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), grp.alias("grp"), F.unhex(leaf).alias("leaf"), F.unhex(F.nullif(other, leaf)).alias("tampered"))
    placed = numbered(scratch.keep(rows), "grp", ["id", "leaf"], scratch).withColumn("block", F.expr(f"pos div {FAN_OUT**levels}"))
    nodes = placed.select("grp", "block", "pos", "leaf", "width").groupBy("grp", "block").applyInPandas(lambda key, pdf: reduced(key, pdf, levels), "grp string, pos long, node string, width long")
    blocks = outer_tree(nodes, scratch)
    groups = blocks.where("pos = 0").select(F.lit("").alias("all"), F.col("grp").alias("name"), F.col("top").alias("node"))
    groups = numbered(groups, "all", ["name"], scratch).select(F.col("all").alias("grp"), "name", "pos", "node", "width")
    roots = outer_tree(groups, scratch).join(groups.select("name", "pos"), "pos").select(F.col("name").alias("grp"), F.col("top").alias("root"), F.col("path").alias("root_path"))
    outer = blocks.join(roots, "grp").select("grp", F.col("pos").alias("block"), F.col("top").alias("subroot"), "root", "path", "root_path")
    kind = docs.schema[id_col].dataType.simpleString()
    placed = placed.withColumn("id", F.col("id").cast("string"))  # pandas has no whole numbers beside null
    out = placed.groupBy("grp", "block").cogroup(scratch.keep(outer).groupBy("grp", "block")).applyInPandas(
        lambda key, pdf, outer: finished(key, pdf, outer, levels), "id string, grp string, pos long, leaf string, subroot string, root string, proof string, folded_root string")
    name = F.when(F.col("grp") != "", F.substring("grp", 2, 2_147_483_647))
    return out.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), name.alias("merkle_group"), F.col("pos").alias("position"))
