"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.numbering import number_within

#: Pieces of one length that are numbered in one task, about.
PER_SLICE = 1_000_000
OUT = ("piece", "start", "length", "bin_id", "bin_size", "bin_offset")

SIZES = (1024, 2048, 4096, 8192, 16384)


def padded_cost(size: int) -> float:
    """Tokens of a sequence and a fixed price for having one more."""
    return size + 64.0


def plan_bins(counts: dict[int, int], sizes: Sequence[int], cost: Callable[[int], float] = padded_cost) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram -> groups of equal bins (size, bins, [(length, items)]).

    Lengths come in descending order. Items go to the open bins with the smallest residual that
    takes them, as many to a bin as fit, before the next larger residual is tried; what is left
    opens bins of the size whose cost per token is least, counting the shorter items that could
    still fill it. In the end each bin shrinks to the smallest size that holds its contents. Work
    and groups grow with the number of lengths, which the largest size bounds, not with the items.
    """
    sizes = sorted(sizes)
    open_bins: dict[int, list[list]] = {}  # residual -> [bins, contents]
    residuals: list[int] = []
    rest = sum(length * n for length, n in counts.items())

    def put(residual: int, bins: int, held: tuple) -> None:
        if not bins:
            return
        if residual not in open_bins:
            open_bins[residual] = []
            insort(residuals, residual)
        open_bins[residual].append([bins, held])

    def fill(bins: int, residual: int, held: tuple, length: int, n: int) -> int:
        """Put items of one length into equal bins; gives the number put."""
        each = residual // length
        full = min(bins, n // each)
        odd = min(n - full * each, each) if full < bins else 0
        put(residual - each * length, full, (*held, (length, each)))
        if odd:
            put(residual - odd * length, 1, (*held, (length, odd)))
        put(residual, bins - full - bool(odd), held)
        return full * each + odd

    for length, n in sorted(counts.items(), reverse=True):
        rest -= length * n
        while n:
            at = bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                bins, held = open_bins[residual].pop()
                if not open_bins[residual]:
                    del open_bins[residual], residuals[at]
                n -= fill(bins, residual, held, length, n)
                continue

            def price(size: int, n: int = n, length: int = length) -> tuple[float, int]:
                each = min(size // length, n)
                bins = -(-n // each)
                return cost(size) / (each * length + min(size - each * length, rest / bins)), size

            size = min(((price(s), s) for s in sizes if s >= length))[1]
            n -= fill(-(-n // (size // length)), size, (), length, n)
    out = []
    for groups in open_bins.values():
        for bins, held in groups:
            contents = sum(length * k for length, k in held)
            out.append((next(s for s in sizes if s >= contents), bins, list(held)))
    return sorted(out)


def pack(df: DataFrame, length: Column, ids: Sequence[str], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = padded_cost) -> DataFrame:
    """One row for each piece: ``ids``, piece, start, length, bin_id, bin_size, bin_offset.

    A row longer than the largest size is cut into pieces of that size and a rest; a row whose
    length is null or not positive has no piece. Only the histogram of piece lengths (at most one
    row for each length up to the largest size) goes to the driver, and what returns is for each
    length the runs of ranks that share a bin pattern; the pieces find their bins by their rank
    among those of the same length, so all of the data stays distributed and no bin is decided in
    one task: those of one length are numbered in slices, whose number grows with them. Repeated rows are packed as
    often as they come. Other columns are not read; ``ids`` named like one of the columns that are added are refused.
    """
    if clash := {c.lower() for c in ids} & {*OUT}:
        raise ValueError(f"ids named like added columns: {', '.join(sorted(clash))}")
    keys = [f"_id{i}" for i in range(len(ids))]
    top = max(sizes)
    pieces = (
        df.select(*[F.col(c).alias(k) for c, k in zip(ids, keys, strict=True)], length.cast("long").alias("_len"))
        .where("_len > 0")
        .select(*keys, "_len", F.explode(F.sequence(F.lit(0), ((F.col("_len") - 1) / top).cast("int"))).alias("piece"))
        .select(*keys, "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("_len") - F.col("piece").cast("long") * top).cast("int").alias("length"))
    )
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    used = dict.fromkeys(counts, 0)
    runs, first = [], 0
    for size, bins, held in plan_bins(counts, sizes, cost):
        offset = 0
        for of, each in held:
            runs.append((of, used[of], used[of] + bins * each, first, each, offset, size))
            used[of] += bins * each
            offset += of * each
        first += bins
    columns = ["length", "lo", "hi", "first", "each", "base", "size"]
    table = df.sparkSession.createDataFrame(pd.DataFrame(runs, columns=columns), "length int, lo long, hi long, first long, each int, base int, size int")
    table = table.groupBy(F.col("length").alias("_l")).agg(F.collect_list(F.struct(*columns[1:])).alias("runs"))
    salts = max(64, -(-max(counts.values(), default=0) // PER_SLICE))
    ranked = number_within(pieces, "length", [*keys, "piece", "start"], "_rank", salts)
    placed = ranked.join(F.broadcast(table), F.col("length") == F.col("_l"))
    placed = placed.withColumn("_run", F.filter("runs", lambda r: (r["lo"] <= F.col("_rank")) & (F.col("_rank") < r["hi"]))[0])
    nth = F.col("_rank") - F.col("_run.lo")
    return placed.select(
        *[F.col(k).alias(c) for c, k in zip(ids, keys, strict=True)],
        "piece",
        "start",
        "length",
        (F.col("_run.first") + F.floor(nth / F.col("_run.each"))).alias("bin_id"),
        F.col("_run.size").alias("bin_size"),
        (F.col("_run.base") + (nth % F.col("_run.each")) * F.col("length")).cast("int").alias("bin_offset"),
    )


def pack_documents(docs: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """Documents as byte-level sequences: UTF-8 bytes and one end token each (a null or empty text
    has the end token only). See ``pack``."""
    return pack(docs.select("doc_id", "text"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1, ["doc_id"], sizes)
