"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.numbering import fresh, number_within

SHARDS_PER_RACK = 2
RACKS_PER_REGION = 4


@dataclass(frozen=True)
class Leaf:
    """One shard: its place in the tree and its weight. Shard ids are positions in the list."""

    region: int
    rack: int
    weight: float = 1.0


def even_tree(n_shards: int) -> list[Leaf]:
    """Equal shards, two to a rack and eight to a region, in order of their ids."""
    return [Leaf(i // (SHARDS_PER_RACK * RACKS_PER_REGION), i // SHARDS_PER_RACK % RACKS_PER_REGION) for i in range(n_shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: the only subtree whose weight changes is the new
    one, so keys move into the new shard and nowhere else."""
    return [*tree, Leaf(max((leaf.region for leaf in tree), default=-1) + 1, 0, weight)]


def _choose(level: str, key: Sequence[Column], path: Sequence[Column], children: Column) -> Column:
    """The child with the least exponential draw -ln(u)/weight: child c wins with probability
    weight(c)/sum of weights, and raising one weight only draws keys towards that child."""

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(level), *path, c["id"]), 11).cast("double") + 0.5) * (2.0**-53)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def _children(pairs: Sequence[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in pairs])


def shard_of(df: DataFrame, key: Sequence[str], tree: Sequence[Leaf], out: str) -> DataFrame:
    """Add ``out``, the shard of each row; key values and the tree alone decide (nulls hash too). Other columns
    stay, whatever their names; one named ``out`` is replaced.

    Three draws are made, each among the children of the node reached so far, weighted by the sum
    of the weights below. When weights change in one subtree, draws elsewhere are untouched: rows
    move only into or out of the subtrees whose weights changed.
    """
    if not tree or min(leaf.weight for leaf in tree) <= 0:
        raise ValueError("a tree needs shards, each with a positive weight")
    regions = sorted({leaf.region for leaf in tree})
    racks = {r: sorted({leaf.rack for leaf in tree if leaf.region == r}) for r in regions}
    weight = lambda r, k=None: sum(x.weight for x in tree if x.region == r and k in (None, x.rack))
    keys = [F.col(c) for c in key]
    region_col, rack_col = fresh(df.columns, f"_{out}_region", f"_{out}_rack")
    by_region = F.create_map(*[x for r in regions for x in (F.lit(r), _children([(k, weight(r, k)) for k in racks[r]]))])
    leaves = {(r, k): [(i, x.weight) for i, x in enumerate(tree) if (x.region, x.rack) == (r, k)] for r in regions for k in racks[r]}
    by_rack = F.create_map(*[x for (r, k), of in leaves.items() for x in (F.lit(f"{r}/{k}"), _children(of))])
    return (
        df.withColumn(region_col, _choose("region", keys, [], _children([(r, weight(r)) for r in regions])))
        .withColumn(rack_col, _choose("rack", keys, [F.col(region_col)], F.element_at(by_region, F.col(region_col))))
        .withColumn(out, _choose("shard", keys, [F.col(region_col), F.col(rack_col)], F.element_at(by_rack, F.concat_ws("/", region_col, rack_col))))
        .drop(region_col, rack_col)
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, salts: int = 256) -> DataFrame:
    """Law ``key`` for documents: shard, slot and the shard with one more shard to choose from.

    ``size`` is the text's UTF-8 bytes plus 8; a null text has no bytes and the crc of none (0).
    Rows with equal or null ids fall in the same shard and get slots of their own. Other columns,
    whatever their names, are not read. No documents give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    tree = even_tree(n_shards)
    rows = shard_of(rows, ["doc_id"], tree, "shard")
    rows = shard_of(rows, ["doc_id"], grown(tree), "grown_shard")
    rows = number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", salts)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
