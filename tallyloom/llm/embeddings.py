"""Embedding near-duplicates: int8 tile products with error bounds, then double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.store import materialise

THRESHOLD = 0.95
TILE = 4096
STRIP = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 codes, their scales, and the norm of what rounding took from each row
    (with room for the arithmetic's own error)."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype("i1"), scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-9


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows with cosine >= threshold; of one tile with itself, each pair once.

    x = s q + e, so x.y <= s_x s_y (q_x.q_y) + |e_x| + (1 + |e_x|) |e_y| for unit vectors. Products of
    int8 codes are whole numbers that float32 holds exactly up to 2**24 (1040 dimensions), so they
    run as matrix products. Only pairs whose bound reaches the threshold are computed in double.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    kind = "f4" if x.shape[1] <= 1040 else "f8"
    right = np.ascontiguousarray(qy.astype(kind).T)
    for at in range(0, len(x), STRIP):
        to = min(at + STRIP, len(x))
        bound = qx[at:to].astype(kind) @ right
        # the pair's own threshold for the whole-number product; float32 has room to spare of 1e-6
        least = (threshold - 1e-5 - ex[at:to, None] - (1 + ex[at:to, None]) * ey[None, :]) / (sx[at:to, None] * sy[None, :])
        i, j = np.nonzero(bound >= least)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, i.size, 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
            yield a[ok], b[ok]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the nodes of linked components the same label, the least."""
    while a.size:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors that are null or zero, hold null or non-finite components, or have no id link with
    nothing; nor do vectors of different lengths. Equal vectors form a class that is compared once, so
    copies cost nothing; a vector's links count all rows of the linked classes and the other rows of
    its own. Rows that repeat a vec_id with unlike vectors are one node: what either vector reaches is one component, and if the id
    is the smallest of both classes, each row counts the links of both. Every two tiles of classes meet in a task of their own, which returns for each class its
    number of links and one link of a spanning forest, never the pairs. The work of an exact comparison is
    quadratic in the number of classes; memory of a task is not. Extra columns are not read.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                x = None if values is None or values.null_count or not len(values) else values.to_numpy(zero_copy_only=False)
                if x is not None and (not np.isfinite(x).all() or not x.any()):
                    x = None
                out.append(None if x is None else (x.astype("f8") + 0.0).tobytes() if x.dtype != np.float32 else (x + np.float32(0)).tobytes())
            wide = [None if x is None else xxhash.xxh3_128_digest(x) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.binary()), pa.array(out, pa.binary())], names=["vec_id", "class", "vec"])

    kind = "f4" if "array<float>" in df.schema[embedding].dataType.simpleString() else "f8"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).mapInArrow(prepare, "vec_id long, class binary, vec binary")
    rows = materialise(rows, "vectors")
    live = rows.where("vec_id IS NOT NULL AND class IS NOT NULL")
    heads = live.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = materialise(rows.select("vec_id", "class").join(heads, "class", "left"), "members")
    reps = members.where("vec_id = rep").select("class", "rep", "copies").distinct()
    classes = live.join(reps, (live.vec_id == reps.rep) & (live["class"] == reps["class"])).select(F.col("rep").alias("id"), "copies", "vec").dropDuplicates(["id", "vec"])
    classes = materialise(classes, "classes")
    side = max(1, -(-classes.count() // tile))
    mine = F.pmod(F.xxhash64("id"), F.lit(side)).cast("int")
    dealt = classes.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    dealt = dealt.select("id", "copies", "vec", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), F.octet_length("vec").alias("width"))

    def compare(table: pa.Table) -> pa.Table:
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left = table.column("left").to_numpy(zero_copy_only=False)
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), f"<{kind}").reshape(len(ids), -1).astype("f8")
        x = x / np.abs(x).max(1)[:, None]  # no square of a component is then too large or too small for a double
        at_x = np.flatnonzero(left)
        at_y = at_x if same else np.flatnonzero(~left)
        n, label = np.zeros(len(ids), "i8"), np.arange(len(ids))
        if at_x.size and at_y.size:
            for a, b in tile_links(x[at_x], x[at_y], threshold, same):
                a, b = at_x[a], at_y[b]
                n += np.bincount(a, copies[b], len(ids)).astype("i8") + np.bincount(b, copies[a], len(ids)).astype("i8")
                _join(label, a, b)
        some = np.flatnonzero(n)
        return pa.table({"id": pa.array(ids[some], pa.int64()), "n": pa.array(n[some], pa.int64()), "peer": pa.array(ids[label[some]], pa.int64())})

    found = materialise(dealt.groupBy("width", "i", "j").applyInArrow(compare, "id long, n long, peer long"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    known = counts.join(labels, counts.id == labels.node, "left").select("id", "n", "component")
    return members.join(known, members.rep == known.id, "left").select(
        "vec_id",
        F.coalesce(F.col("n") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
