"""Document fingerprints: bottom-k sketches of word-shingle hashes, in SQL expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialise

K = 64
WIDTH = 5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all word shingles in order; fewer words than ``width`` make one shingle, none make none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")

    def of(h: Column) -> Column:
        full = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]))
        return F.when(F.size(h) >= width, full).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch: the k least distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom(shingles(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets, from their sketches alone."""
    return bottom(F.concat(a, b), k)


def merge_groups(df: DataFrame, group: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """The sketch of each group's union. Hashes are made distinct before they are gathered, and the
    least k are found first in ``_part`` slices of a group, so hot groups stay spread out."""
    each = df.select(*group, F.explode(sketch_col).alias("_h")).distinct()
    slices = each.withColumn("_part", F.pmod(F.col("_h"), F.lit(64)))
    nth = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_h"))
    least = slices.withColumn("_n", nth).where(F.col("_n") <= k)
    return least.groupBy(*group).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both have; two empty sets are alike."""
    union = merge(a, b, k)
    both = F.array_intersect(a, b)
    shared = _let(union, lambda u: F.size(F.array_intersect(u, both)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the kth hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance * |a or b| / |a|, at most 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, prev_id, take: the document before each one (the last before the first) and a quarter
    of that one's length. Ids are dealt by range; only the first id of each range looks beyond it."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.length(F.coalesce(F.col("text"), F.lit("")))).alias("n"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy("doc_id")
    here = ranged.withColumn("before", F.lag(F.struct("doc_id", "n")).over(inside))
    ends = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "n")).alias("end"))
    chain = Window.orderBy("part")
    last = F.last("end").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", F.coalesce(F.lag("end").over(chain), last).alias("left"))
    return here.join(ends, "part").select("doc_id", F.coalesce("before", "left").alias("p")).select("doc_id", F.col("p.doc_id").alias("prev_id"), F.floor(F.col("p.n") / 4).cast("int").alias("take"))


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, how alike the sketches are, and what they
    estimate of the text: its distinct shingles, and the share of them that the edited text has.

    The edited text has its last quarter replaced by the start of the next document's. Null texts
    are empty. Rows without doc_id have no next document: their edited text is their own, near_next
    is 0. Of rows with one doc_id, the one with the least text hash stands for the id before it.
    Each text is shuffled once; of the next document only the start that is needed moves again.
    """
    named = F.col("doc_id").isNotNull()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text"), k))
    before = successors(docs).withColumnRenamed("doc_id", "id")
    heads = (
        rows.where(named)
        .join(before.hint("merge"), F.col("doc_id") == F.col("id"))
        .select(F.col("prev_id").alias("of"), F.xxhash64("text").alias("h"), F.substring("text", F.lit(1), F.col("take")).alias("head"), F.col("sketch").alias("next_sketch"))
        .groupBy("of")
        .agg(F.min(F.struct("h", "head", "next_sketch")).alias("n"))
        .select("of", "n.head", "n.next_sketch")
    )
    # both sides of this join start from one shuffle of the texts; rows without an id need none
    joined = rows.where(named).join(heads, F.col("doc_id") == F.col("of"), "left")
    alone = rows.where(~named).select("*", *[F.lit(None).cast(t).alias(c) for c, t in heads.dtypes])
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.when(F.col("of").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("head", F.lit(1), quarter)))
    return (
        joined.unionByName(alone)
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
        .withColumn("edited_sketch", sketch(F.col("edited"), k))
        .select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            as_text(F.col("sketch")).alias("fingerprint"),
            as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
            resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
            F.coalesce(resemblance(F.col("sketch"), F.col("next_sketch"), k), F.lit(0.0)).alias("near_next"),
            distinct_count(F.col("sketch"), k).alias("n_distinct"),
            containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_edited"),
        )
    )
