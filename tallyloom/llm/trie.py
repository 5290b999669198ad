"""The trie of conversations: which begin alike, for how many turns, and what sharing these would save.

Each conversation is scanned once: the fingerprint of its first d turns is a sum of turn hashes times powers of a base, modulo
2^64. Equal depths and fingerprints make candidate groups. Each group is verified: a member's turn at that depth must equal the
representative's (that of the smallest conv_id); by induction over the depths, members that pass at all of them have
equal prefixes. Members that differ are a collision and split from the group, with all that follows.

A node belongs to its smallest member. As groups only shrink with depth, a conversation that has a node has all nodes below
it on its own path, so sums over subtrees need no walk level by level: each conversation sums its own nodes from its end
upwards, and hands the sum to each node on its path.

Long conversations are cut in slices of ``SLICE`` turns. Scans run in the slices, and from slice to slice over their totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialise

SLICE = 1024
#: conv_ids whose decimals are joined before they move.
JOINED = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text of all turns, by turn (null first), then role and text. Rows are sorted over the whole
    table, so a conversation of any length is spread over tasks, and numbered there from where the task before ends."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id IS NOT NULL")
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_tie")).withColumn("_part", F.spark_partition_id()).drop("_tie")
    placed = materialise(spread, "turns")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("conv_id", "_part").orderBy(*keys[1:])
    numbered = placed.withColumn("_row", F.row_number().over(inside))
    return numbered.join(starts, ["conv_id", "_part"]).select("conv_id", (F.col("_start") + F.col("_row")).alias("pos"), "role", "text")


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c anew, from the first h turns of conversation c - c % 100 (all if it has fewer,
    none if it isn't there) and its own turns after the first h, h = crc32 of its decimal conv_id, modulo 6. ``turns``: conv_id,
    depth from 1, role, text, last (whether it is the last); ``conversations``: conv_id, length, those without turns too."""
    turns = materialise(number_turns(conversations), "numbered")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.withColumns({"h": F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)), "base": F.col("conv_id") - F.col("conv_id") % 100})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("head", head).withColumn("length", F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = materialise(convs.select("conv_id", "base", "h", "head", "length"), "lengths")
    own = turns.join(convs.select("conv_id", "h", "head", "length"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "role", "text", "length")
    lent = turns.where("pos <= 5").withColumnRenamed("conv_id", "base").join(convs.where("head > 0"), "base").where("pos <= head").select("conv_id", F.col("pos").alias("depth"), "role", "text", "length")
    rebuilt = own.unionByName(lent).select("conv_id", "depth", "role", "text", (F.col("depth") == F.col("length")).alias("last"))
    return rebuilt, convs.select("conv_id", "length")


def _scanned(df: DataFrame, group: list[str], place: str, value: str, out: str, bits: int = 64) -> DataFrame:
    """``df`` with ``out``, in each group the sum of ``value`` times the base to the power of ``place`` over the rows up to each
    one by ``place``, modulo 2^64; only its lowest ``bits`` are kept."""
    names = [*df.columns, out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} long"
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, before = np.uint64(0), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in group])
            terms = batch.column(value).to_numpy().view("u8") * np.power(_BASE, batch.column(place).to_numpy().astype("u8"))
            sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(terms)])
            firsts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            base = sums[firsts]
            if before is not None and (keys[:, 0] == before).all():
                base[0] -= carried
            found = sums[1:] - np.repeat(base, np.diff(np.append(firsts, n)))
            carried, before = found[-1], keys[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((found & mask).view("i8"))], names=names)

    return df.repartition(*group).sortWithinPartitions(*group, place).mapInArrow(run, schema)


def fingerprints(turns: DataFrame, bits: int = 64) -> DataFrame:
    """``turns`` with slice, before and print: a turn's slice, the fingerprint of the slices before it (0 in the first) and that of
    its slice up to the turn. ``bits``: so many of the fingerprints' bits are kept; fewer make collisions."""
    rows = turns.select("conv_id", F.floor((F.col("depth") - 1) / SLICE).alias("slice"), "depth", "role", "text", "last", F.xxhash64("role", F.length("role"), "text").alias("hash"))
    scanned = materialise(_scanned(rows, ["conv_id", "slice"], "depth", "hash", "print", bits).drop("hash"), "prints")
    cut = scanned.where("slice > 0").select("conv_id").distinct()
    totals = scanned.join(cut, "conv_id", "left_semi").groupBy("conv_id", "slice").agg(F.max_by("print", "depth").alias("total"))
    offsets = _scanned(totals, ["conv_id"], "slice", "total", "before", bits).select("conv_id", (F.col("slice") + 1).alias("slice"), "before")
    return scanned.join(offsets, ["conv_id", "slice"], "left").fillna(0, ["before"])


def verified(prints: DataFrame) -> DataFrame:
    """``prints`` with ``split``, '' for all that the fingerprints group rightly. In each group of one depth and fingerprint every
    distinct turn is compared with the representative's; members with another turn, and what follows theirs, are told
    apart by ``split``, the depths and least conv_ids of these turns so far."""
    prints = materialise(prints, "grouped")
    key = ["depth", "before", "print"]
    kinds = materialise(prints.groupBy(*key, "role", "text").agg(F.min("conv_id").alias("least")), "kinds")
    reps = kinds.groupBy(*key).agg(F.min_by(F.struct("role", "text"), "least").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = materialise(kinds.join(reps, key).where((F.col("role") != F.col("rep.role")) | (F.col("text") != F.col("rep.text"))).select(*key, "role", "text", F.concat_ws(":", "depth", "least").alias("kind")), "collisions")
    if other.isEmpty():
        return prints.withColumn("split", F.lit(""))
    marked = prints.join(other, [*key, "role", "text"], "left")
    hit = marked.where("kind IS NOT NULL").groupBy("conv_id").agg(F.collect_list(F.struct("depth", "kind")).alias("kinds"))
    so_far = F.array_join(F.transform(F.filter(F.array_sort("kinds"), lambda k: k["depth"] <= F.col("depth")), lambda k: k["kind"]), ",")
    return marked.drop("kind").join(hit, "conv_id", "left").withColumn("split", F.coalesce(so_far, F.lit(""))).drop("kinds")


def prefix_trie(turns: DataFrame, conversations: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations' trie.

    ``turns``: conv_id, depth (from 1 without gaps), role, text, last; ``conversations``: conv_id, length. ``nodes``: conv_id (the
    smallest member's), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves (nodes without children in
    its subtree, itself included), saved_tokens (over its subtree, n_convs - 1 times the code points of the last text). ``ends``: conv_id,
    depth, member, the node at which each conversation ends. Conversations without turns end at the root. Without
    conversations there are no nodes.
    """
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    found = root.first()
    top = F.lit(found["conv_id"] if found else None).cast("long")
    key = ["depth", "before", "print", "split"]
    rows = materialise(verified(fingerprints(turns, bits)).select("conv_id", "slice", *key, F.char_length("text").cast("long").alias("size"), "last"), "paths")
    groups = rows.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.count_if("last").alias("n_ends"))
    groups = materialise(groups, "nodes")
    path = rows.join(groups, key).select("conv_id", "slice", "depth", "rep", "n", "last", (F.col("last") & (F.col("n_ends") == F.col("n")) & (F.col("rep") == F.col("conv_id"))).cast("int").alias("leaf"), F.when(F.col("rep") == F.col("conv_id"), (F.col("n") - 1) * F.col("size")).otherwise(0).alias("saved"))
    down = Window.partitionBy("conv_id", "slice").orderBy("depth")
    whole = Window.partitionBy("conv_id", "slice")
    path = materialise(
        path.withColumns({"parent": F.lag("rep").over(down), "below": F.sum("saved").over(down.rowsBetween(0, Window.unboundedFollowing)), "leaf": F.max("leaf").over(whole)}).select("conv_id", "slice", "depth", "rep", "n", "last", "leaf", "parent", "below"), "scanned"
    )
    cut = path.where("slice > 0").select("conv_id").distinct()
    ends = path.join(cut, "conv_id", "left_semi").groupBy("conv_id", "slice").agg(F.max_by("rep", "depth").alias("end"), F.max("below").alias("total"), F.max("leaf").alias("ends"))
    over = Window.partitionBy("conv_id").orderBy("slice")
    ends = ends.select("conv_id", "slice", F.lag("end").over(over).alias("entry"), F.coalesce(F.sum("total").over(over.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("later"), F.max("ends").over(Window.partitionBy("conv_id")).alias("ends"))
    path = path.join(ends, ["conv_id", "slice"], "left").select("conv_id", "depth", "rep", "n", "last", F.coalesce("ends", "leaf").alias("leaf"), F.coalesce("parent", "entry").alias("parent"), (F.col("below") + F.coalesce("later", F.lit(0))).alias("below"))
    path = materialise(path, "path")

    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    own = path.where("rep = conv_id").withColumn("parent", F.coalesce("parent", top))
    made = own.select(F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    made = made.unionByName(root.select("conv_id", zero.alias("depth"), none.alias("parent_conv_id"), F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens")))
    children = own.select(F.col("parent").alias("conv_id"), (F.col("depth") - 1).cast("long").alias("depth"), none.alias("parent_conv_id"), none.alias("n_convs"), F.lit(1).cast("long").alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    gives = path.where("below > 0 OR leaf > 0")
    given = gives.select(F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), none.alias("parent_conv_id"), none.alias("n_convs"), zero.alias("n_children"), F.col("leaf").cast("long").alias("n_leaves"), F.col("below").alias("saved_tokens"))
    to_root = gives.where("depth = 1").select(top.alias("conv_id"), zero.alias("depth"), none.alias("parent_conv_id"), none.alias("n_convs"), zero.alias("n_children"), F.col("leaf").cast("long").alias("n_leaves"), F.col("below").alias("saved_tokens"))
    nodes = (
        made.unionByName(children).unionByName(given).unionByName(to_root)
        .groupBy("conv_id", "depth")
        .agg(F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
    )
    bare = conversations.where("length = 0").select(top.alias("conv_id"), zero.alias("depth"), F.col("conv_id").alias("member"))
    return nodes, path.where("last").select(F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("conv_id").alias("member")).unionByName(bare)


def member_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256: SHA-256 of the members' decimal conv_ids, ascending, comma-joined. Runs of ids are joined
    before they move; what a node has then streams through one hash, never held as a whole."""
    runs = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / JOINED).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (conv, depth) != of:
                    if of is not None:
                        done.append((*of, digest.hexdigest()))
                    of, digest = (conv, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield out(done)
        if of is not None:
            yield out([(*of, digest.hexdigest())])

    def out(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])

    ordered = runs.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run").select("conv_id", "depth", "ids")
    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def shared_prefixes(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (of the members that end there).

    Turns are ordered by turn (null first), then by role and text; null roles and texts are empty. Rows without conv_id belong to no
    conversation. Rows that repeat are turns of their own. No conversations give no nodes. Other columns are not read.
    """
    turns, convs = rebuild(conversations)
    nodes, ends = prefix_trie(turns, convs, bits)
    nodes = materialise(nodes, "trie")
    named = nodes.join(materialise(member_digests(ends), "digests"), ["conv_id", "depth"], "left")
    return named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(cast({0} as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 1, 2, 3, 4, 5, 6, 7]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
#: DuckDB SQL for the whole result.
SQL = f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 100 as base, {_CRC.format('conv_id')} % 6 as h, list({{'r': role, 't': text}} order by pos) as own from t group by conv_id),
built as (select c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) as s from convs c left join convs b on c.base = b.conv_id),
prefixes as (select conv_id, len(s) as length, unnest(range(0, len(s) + 1)) as depth, s from built),
keyed as (select conv_id, depth, depth = length as ends, sha256(cast(list_slice(s, 1, depth) as varchar)) as k, case when depth > 0 then sha256(cast(list_slice(s, 1, depth - 1) as varchar)) end as pk, case when depth > 0 then length(s[depth].t) else 0 end as size from prefixes),
nodes as (select depth, k, any_value(pk) as pk, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256 from keyed group by depth, k),
kids as (select depth - 1 as depth, pk as k, count(*) as n from nodes where depth > 0 group by all),
full_ as (select n.*, coalesce(kids.n, 0) as n_children from nodes n left join kids on n.depth = kids.depth and n.k = kids.k),
below as (select up.depth, up.k, sum((f.n_convs - 1) * f.size) as saved, count(*) filter (where f.n_children = 0) as leaves from full_ f join keyed up on f.conv_id = up.conv_id and up.depth <= f.depth group by all)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, f.ends_sha256
from full_ f join below b on f.depth = b.depth and f.k = b.k left join nodes p on p.depth = f.depth - 1 and p.k = f.pk"""
