"""Shards by a hierarchical weighted hash tree (operator 9), in column expressions only.

A row descends region, rack and shard; at each node every child draws ``-ln(u) / weight``
with u hashed from the row's key and the child's path, and the least draw wins. A child's
draw depends on its own weight alone, so when a weight grows rows move only into that
child's subtree. A shard added as a region of its own therefore takes rows only into itself.

Law ``key``: doc_id and the tree decide. Defined results: a null doc_id draws as the text
"null"; a null text has no bytes (size 8, checksum 0); repeated rows go to one shard and
get slots of their own; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, stored


@dataclass(frozen=True)
class Node:
    """A named subtree: a leaf is a shard, an inner node's weight is that of its leaves."""

    path: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, base: int = 24, racks: int = 2, per_rack: int = 4) -> Node:
    """Regions of ``racks`` x ``per_rack`` shards up to ``base``; each later shard is a region of its own.

    So the tree of n + 1 shards beyond ``base`` is that of n with one more region.
    """
    regions, size = [], racks * per_rack
    for r in range(0, min(shards, base), size):
        held = list(range(r, min(r + size, shards, base)))
        regions.append(Node(f"r{r // size}", tuple(
            Node(f"r{r // size}/k{k // per_rack}", tuple(Node(f"r{r // size}/k{k // per_rack}/s{s}", shard=s) for s in held[k:k + per_rack]))
            for k in range(0, len(held), per_rack))))
    for s in range(base, shards):
        regions.append(Node(f"x{s}", (Node(f"x{s}/k0", (Node(f"x{s}/k0/s{s}", shard=s),)),)))
    return Node("", tuple(regions))


def draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential draw at the rate of the child's weight: 53 hashed bits, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("|", path, key)), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def _kids(node: Node) -> Column:
    return F.array(*[F.struct(F.lit(c.path).alias("path"), F.lit(float(c.weight)).alias("weight"), F.lit(c.shard).alias("shard"))
                     for c in node.children])


def _win(key: Column, kids: Column) -> Column:
    """The child of the least draw (then the least path)."""
    return F.array_min(F.transform(kids, lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("d"), c["path"].alias("path"), c["shard"].alias("shard"))))


def shard_of(key: Column, root: Node) -> Column:
    """The shard of ``key`` under ``root``: the winning region, its winning rack, its winning shard."""
    def below(nodes: list[Node]) -> Column:
        return F.create_map(*[x for n in nodes for x in (F.lit(n.path), _kids(n))])

    racks = [k for r in root.children for k in r.children]
    region = _win(key, _kids(root))["path"]
    rack = _win(key, F.element_at(below(list(root.children)), region))["path"]
    return _win(key, F.element_at(below(racks), rack))["shard"].cast("int")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: size, checksum, shard, slot in it, and its shard under one shard more."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("shard", shard_of(key, tree(shards))).withColumn("grown_shard", shard_of(key, tree(shards + 1)))
    placed = gapless_rank(stored(rows, "shards"), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
