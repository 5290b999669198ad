"""Language-model scores by context-tree weighting over byte contexts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import materialise

#: Bytes of context.
DEPTH = 5
#: Contexts of so many bytes meet on the driver, a row for each decision in them: 65,536 contexts of 255 decisions at most, whatever the
#: corpus (16.7 million rows, about 535 MB), of which text has few: 1,642 contexts and 30,886 decisions in 25 MB of four languages. The
#: longer ones stay in buckets.
TOP = 2
BLOCK_BYTES = 8 << 20
#: Windows that are in memory together; a longer text is taken in stretches.
STRIP = 8 << 20
#: A byte that UTF-8 never has: it stands before a text and ends it.
EDGE = 0xFF
#: White space is never part of a word, so this names the end token.
END = xxhash.xxh3_64_intdigest(b" ")
#: Counts whose logarithms of the gamma function are looked up.
_SMALL = 4096


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: eight recurrence steps, then Stirling's series."""
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += np.log(x)
        x = x + 1
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


_WHOLE = np.array([math.lgamma(n + 1) for n in range(_SMALL)])
_HALF = np.array([math.lgamma(n + 0.5) for n in range(_SMALL)])


def _looked(table: np.ndarray, counts: np.ndarray, add: float) -> np.ndarray:
    """ln of the gamma function at counts + add, which are whole numbers mostly small."""
    out = table.take(np.minimum(counts, _SMALL - 1).astype("i8"))
    big = counts >= _SMALL
    if big.any():
        out[big] = log_gamma(counts[big] + add)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _looked(_HALF, zeros, 0.5) + _looked(_HALF, ones, 0.5) - np.log(np.pi) - _looked(_WHOLE, zeros + ones, 1.0)


def bit_counts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts[context, 256] -> zeros and ones at each of the 255 inner nodes of the byte's binary
    decomposition, the highest bit first (node 1 is the root; node 0 is not used)."""
    zeros, ones = np.zeros_like(symbols), np.zeros_like(symbols)
    level = symbols
    for depth in range(7, -1, -1):
        zeros[:, 1 << depth : 2 << depth], ones[:, 1 << depth : 2 << depth] = level[:, ::2], level[:, 1::2]
        level = level[:, ::2] + level[:, 1::2]
    return zeros, ones


@dataclass
class ContextTree:
    """log10 P(byte | context) for each node of the tree; ``contexts[d]`` are the sorted codes of the
    nodes with d bytes of context, whose rows of ``table`` start at ``first[d]``."""

    contexts: list[np.ndarray]
    first: list[int]
    table: np.ndarray

    def rows(self, before: np.ndarray) -> np.ndarray:
        """The deepest node of each context (DEPTH bytes, the latest lowest)."""
        at = np.zeros(before.size, "i4")
        left = None
        for d in range(len(self.contexts) - 1, 0, -1):
            known = self.contexts[d]
            if not known.size:
                continue
            own = before if left is None else before[left]
            own = own & np.uint64((1 << 8 * d) - 1)
            place = np.minimum(np.searchsorted(known, own), known.size - 1)
            hit = known[place] == own
            if left is None:
                at[hit] = place[hit] + self.first[d]
                left = np.flatnonzero(~hit)
            else:
                at[left[hit]] = place[hit] + self.first[d]
                left = left[~hit]
        return at


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
    """The tree of (codes, counts[context, 256]) for contexts of 0, 1, ... bytes, in memory: what
    ``window_logs`` computes in buckets, in its plain form.

    A node's children are the contexts one byte longer; those too rare to be nodes share one more leaf,
    which holds what the node has and its children don't. With P_e the KT estimate and P_w = P_e at
    leaves, every inner node has P_w = (P_e + product of its children's P_w) / 2, for each of the
    255 binary decisions of a byte. The prediction mixes the estimates of all depths along a context
    with the weights that this gives after the training data.
    """
    half = np.log(0.5)
    depths = len(levels)
    parent = [np.zeros(0, "i8")] + [np.searchsorted(levels[d - 1][0], levels[d][0] & np.uint64((1 << 8 * (d - 1)) - 1)) for d in range(1, depths)]
    own, leaf, share = ([np.zeros(0, "f4")] * depths for _ in range(3))  # predictions of a 1, and weights of the node itself
    above = np.zeros(0)
    for d in range(depths - 1, -1, -1):
        zeros, ones = bit_counts(levels[d][1])
        estimate = kt(zeros, ones)
        own[d] = ((ones + 0.5) / (zeros + ones + 1)).astype("f4")
        if d == depths - 1:
            leaf[d], share[d], above = own[d], np.ones_like(own[d]), estimate
            continue
        rest = levels[d][1].copy()
        np.subtract.at(rest, parent[d + 1], levels[d + 1][1])
        zeros, ones = bit_counts(np.maximum(rest, 0))
        leaf[d] = ((ones + 0.5) / (zeros + ones + 1)).astype("f4")
        below = kt(zeros, ones)
        np.add.at(below, parent[d + 1], above)
        above = np.logaddexp(half + estimate, half + below)
        share[d] = np.exp(half + estimate - above).astype("f4")
    tables, first = [], []
    for d in range(depths):
        first.append(sum(len(t) for t in tables))
        p = leaf[d].astype("f8")
        at = np.arange(len(p))
        for up in range(d, -1, -1):
            p = share[up][at] * own[up][at] + (1 - share[up][at]) * p
            at = parent[up][at] if up else at
        log = np.zeros((len(p), 1), "f4")
        for depth in range(8):
            one = p[:, 1 << depth : 2 << depth]
            log = np.stack([log + np.log10(1 - one), log + np.log10(one)], 2).reshape(len(p), -1).astype("f4")
        tables.append(log)
    return ContextTree([c for c, _ in levels], first, np.concatenate(tables))


def _strips(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(first, windows): in order, the windows that end at each byte and at the end of some texts from ``first`` on, or of
    a stretch of one, each above the 16 bits of its text's number after ``first``.

    A window's code has DEPTH + 1 bytes. The last is lowest; its context goes from the latest byte, highest, to the
    earliest, so that what shares a context is a range.
    """
    pieces: list[bytes] = []
    of: list[int] = []
    held = 0

    def given() -> tuple[int, np.ndarray]:
        joined = np.frombuffer(b"".join(pieces), "u1")
        sizes = np.fromiter(map(len, pieces), "i8", len(pieces)) - DEPTH
        code = np.zeros(joined.size, "u8")
        step = 1 << 16
        for lo in range(0, joined.size, step):
            part = code[lo : lo + step]
            for back in range(DEPTH + 1):
                skip = max(0, back - lo)
                shift = 16 + (8 * (DEPTH + 1 - back) if back else 0)
                part[skip:] |= joined[lo + skip - back : lo + part.size - back].astype("u8") << np.uint64(shift)
        real = np.ones(joined.size, bool)
        begins = np.cumsum(sizes + DEPTH) - sizes - DEPTH
        for i in range(DEPTH):
            real[begins + i] = False
        code = code[real]
        code |= np.repeat(np.array(of, "u8") - np.uint64(of[0]), sizes)
        code.sort()
        return of[0], code

    for i, t in enumerate(texts):
        whole = bytes([EDGE]) * DEPTH + t + b"\xff"
        at = 0
        while at < len(t) + 1:
            if of and i - of[0] >= 1 << 16 or held >= STRIP:
                yield given()
                pieces, of, held = [], [], 0
            to = min(len(t) + 1, at + STRIP - held)
            pieces.append(whole[at : to + DEPTH])
            of.append(i)
            held += to - at
            at = to
    if held:
        yield given()


def _runs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a strip, and where each begins."""
    code = windows >> np.uint64(16)
    first = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
    return code[first], first


def _texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes, A-Z in lower case."""
    return pc.ascii_lower(column).cast(pa.binary()).to_pylist()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0].astype("i8")
    k, n = np.concatenate(keys), np.concatenate(counts)
    own, inverse = np.unique(k, return_inverse=True)
    return own, np.bincount(inverse, n, own.size).astype("i8")


def _window_counts(texts: list[bytes], taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts and how often each is in those that are ``taught``."""
    keys, counts = [], []
    for at, windows in _strips(texts):
        own, first = _runs(windows)
        keys.append(own)
        counts.append(np.add.reduceat(taught[at + (windows & np.uint64(0xFFFF)).astype("i8")].astype("i4"), first))
    return _summed(keys, counts)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts: sorted hashes of the distinct ones, the place of each token's there, and its text's number."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    sizes = np.diff(np.asarray(parts.offsets))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), sizes)
    own, place = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words)), return_inverse=True)
    real = np.array([bool(w) for w in words], bool)
    if not real.all():  # white space at an end of a text gives empty words
        kept = real[code]
        code, owner = code[kept], owner[kept]
        empty = own == np.uint64(xxhash.xxh3_64_intdigest(b""))
        place, own = place - np.cumsum(empty)[place], own[~empty]
    return own, place[code], owner


def _word_counts(column: pa.Array, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts and the end, and how often each is in those that are ``taught``."""
    own, place, owner = _tokens(column)
    n = np.bincount(place, taught[owner], own.size).astype("i8")
    return _summed([own, np.array([END], "u8")], [n, np.array([taught.sum()], "i8")])


def _pack(values: np.ndarray) -> bytes:
    """Numbers as bytes of equal weight side by side, which compress well."""
    return values.view("u1").reshape(-1, values.itemsize).T.tobytes()


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, "u1").reshape(size, -1).T.copy().reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "u8"), dtype="u8")


def _mixed_up(x: np.ndarray, buckets: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype("i4")


def _dealt(keys: np.ndarray, buckets: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of keys (windows by the TOP + 1 latest bytes of their contexts; words have buckets of their own, above), the
    order in which their keys stand, and where each one's begin there."""
    of = _mixed_up(keys, buckets) + buckets if words else _mixed_up(keys >> np.uint64(8 * (DEPTH - TOP)), buckets)
    order = np.argsort(of.astype("u2") if 2 * buckets <= 1 << 16 else of, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1]) if keys.size else np.zeros(0, "i8")
    return of[order][first], order, first


@dataclass
class _Level:
    """Binary decisions (context and node, ``codes``) at one length of context: zeros, ones, own
    prediction of a 1 and weight, ln P_w, and where each one's parent with one byte less stands."""

    codes: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    estimate: np.ndarray
    weighted: np.ndarray
    up: np.ndarray

    @property
    def own(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1)

    @property
    def share(self) -> np.ndarray:
        return np.exp(np.log(0.5) + self.estimate - self.weighted)


def _level(codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> _Level:
    estimate = kt(zeros, ones)
    weighted = estimate if below is None else np.logaddexp(np.log(0.5) + estimate, np.log(0.5) + below)
    return _Level(codes, zeros, ones, estimate, weighted, np.zeros(0, "i8"))


def _shorter(level: _Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, zeros, ones and the children's ln P_w for contexts with one byte less; sets ``level.up``."""
    codes = (level.codes >> np.uint64(16) << np.uint64(8)) | (level.codes & np.uint64(255))
    own, level.up = np.unique(codes, return_inverse=True)
    return own, *(np.bincount(level.up, x, own.size).astype("f8") for x in (level.zeros, level.ones, level.weighted))


def _deep(keys: np.ndarray, n: np.ndarray) -> tuple[list[_Level], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the windows of whole buckets: levels of DEPTH to TOP + 1 bytes, each window's eight
    decisions at the first of them, and what goes to TOP."""
    byte = (keys & np.uint64(255)).astype("i8")[:, None]
    depth = np.arange(8)
    node = (1 << depth) | (byte >> (8 - depth))
    codes = (keys >> np.uint64(8) << np.uint64(8))[:, None] | node.astype("u8")
    own, at = np.unique(codes.ravel(), return_inverse=True)
    bit = byte >> (7 - depth) & 1
    given = n.astype("f8")[:, None]
    levels = [_level(own, np.bincount(at, (given * (1 - bit)).ravel(), own.size), np.bincount(at, (given * bit).ravel(), own.size), None)]
    above = _shorter(levels[0])
    for _ in range(DEPTH - TOP - 1):
        levels.append(_level(*above))
        above = _shorter(levels[-1])
    return levels, at.reshape(-1, 8), above


def _mixed(level: _Level, part: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the weighted predictions down to this level, and the weight left for longer contexts."""
    part, left, share = part[level.up], left[level.up], level.share
    return part + left * share * level.own, left * (1 - share)


def _shallow(codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_mixed`` at TOP bytes of context, for each of ``codes``."""
    levels = [_level(codes, zeros, ones, below)]
    for _ in range(TOP):
        levels.append(_level(*_shorter(levels[-1])))
    levels[-1].up = np.zeros(levels[-1].codes.size, "i8")
    part, left = np.zeros(1), np.ones(1)
    for level in reversed(levels):
        part, left = _mixed(level, part, left)
    return part, left


def _grouped(keys: np.ndarray, n: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted windows in pieces of about ``most``, cut only where the TOP + 1 latest bytes change."""
    context = keys >> np.uint64(8 * (DEPTH - TOP))
    at = 0
    while at < keys.size:
        end = keys.size if at + most >= keys.size else int(np.searchsorted(context, context[at + most], "right"))
        yield keys[at:end], n[at:end]
        at = end


def window_logs(windows: DataFrame) -> DataFrame:
    """bucket, keys, values: log10 of each window's last byte after the others, from
    ``windows(bucket, keys, n)`` with all windows of a bucket in one row and their training counts.

    Every context that occurs is a node. With P_e the KT estimate and P_w = P_e at DEPTH bytes,
    every shorter context has P_w = (P_e + product of its children's P_w) / 2, for each of the binary
    decisions of a byte; decisions without counts have probability 1/2. Contexts of more than TOP bytes
    lie whole in a bucket and never leave it; the shorter ones are added up over the buckets. Windows
    that only other texts have come with n = 0.
    """

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for keys, counts in _grouped(_unpack_keys(k), _unpack(n, "i8")):
                    codes, *sums = _deep(keys, counts)[2]
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype("i8")), *map(pa.array, sums)], names=["code", "zeros", "ones", "below"])

    short = windows.select("bucket", "keys", "n").mapInArrow(up, "code long, zeros double, ones double, below double").groupBy("code").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    found = short.toArrow().sort_by("code")
    top, zeros, ones, below = (found.column(c).to_numpy() for c in ("code", "zeros", "ones", "below"))
    top = top.astype("u8")
    sent = windows.sparkSession.sparkContext.broadcast((top.astype("u4"), *_shallow(top, zeros, ones, below)))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, *above = sent.value
        for batch in batches:
            for bucket, k, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                logs = []
                for keys, counts in _grouped(_unpack_keys(k), _unpack(n, "i8")):
                    levels, at, (codes, *_) = _deep(keys, counts)
                    place = np.searchsorted(top, codes.astype("u4"))
                    part, left = (x[place] for x in above)
                    for level in reversed(levels[1:]):
                        part, left = _mixed(level, part, left)
                    one = (part[levels[0].up] + left[levels[0].up] * levels[0].own)[at]
                    bit = (keys & np.uint64(255)).astype("i8")[:, None] >> (7 - np.arange(8)) & 1
                    logs.append(np.log10(np.where(bit == 1, one, 1 - one)).sum(1).astype("f4"))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([k], pa.binary()), pa.array([_pack(np.concatenate(logs))], pa.binary())], names=["bucket", "keys", "values"])

    return windows.select("bucket", "keys", "n").mapInArrow(down, "bucket int, keys binary, values binary")


def _merged(parts: DataFrame) -> DataFrame:
    """bucket, keys, n, total, known: the keys of each bucket and their sums, from parts of it, and over them the sum and
    how many are not 0. A bucket's parts come one after another and are added up as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = None, [], 0

        def given() -> pa.RecordBatch:
            keys, n = _summed(*zip(*held, strict=True))
            columns = [pa.array([own], pa.int32()), pa.array([_pack_keys(keys)], pa.binary()), pa.array([_pack(n)], pa.binary()), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "n", "total", "known"])

        for batch in batches:
            for bucket, k, n in zip(*(batch.column(i) for i in range(3)), strict=True):
                if bucket.as_py() != own and held:
                    yield given()
                    held, size = [], 0
                own = bucket.as_py()
                held.append((_unpack_keys(k.as_py()), _unpack(n.as_py(), "i4")))
                size += held[-1][0].size
                if size > 4_000_000 and size > 2 * held[0][0].size:
                    held = [_summed(*zip(*held, strict=True))]
                    size = held[0][0].size
        if held:
            yield given()

    return parts.select("bucket", "keys", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, keys binary, n binary, total long, known long")


def _looked_up(parts: DataFrame, tables: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, values: the values of each part's keys, in order. A bucket's table comes before its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = np.zeros(0, "u8"), np.zeros(0, "f4")
        for batch in batches:
            blocks, own, values = [], [], []
            for bucket, block, k, v in zip(*(batch.column(i) for i in range(4)), strict=True):
                keys = _unpack_keys(k.as_py())
                if block.as_py() < 0:
                    known, table = keys, _unpack(v.as_py(), "f4" if bucket.as_py() < buckets else "i8")
                else:
                    blocks.append(block.as_py())
                    own.append(bucket.as_py())
                    values.append(_pack(table[np.searchsorted(known, keys)]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(own, pa.int32()), pa.array(values, pa.binary())], names=["block", "bucket", "values"])

    both = tables.select("bucket", F.lit(-1).cast("long").alias("block"), "keys", "values").unionByName(parts.select("bucket", "block", "keys", F.lit(None).cast("binary").alias("values")))
    return both.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, bucket int, values binary")


def _compressed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _blocks(texts: DataFrame, buckets: int, block_bytes: int) -> DataFrame:
    """Rows of two sorts: block, texts with all documents (doc_id, held_out, text) of a block, compressed; and block, bucket,
    keys, n of the windows and the words that it has, with their counts in its training texts. A block is what a task reads one after another, about
    ``block_bytes`` of text, so equal rows need not meet."""
    from pyspark import TaskContext

    names = ["block", "texts", "bucket", "keys", "n"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def given() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            text, out = (table.column(c).chunk(0) for c in ("text", "held_out"))
            yield rows(block=pa.array([block]), texts=pa.array([_compressed(table)], pa.binary()))
            taught = ~out.to_numpy(zero_copy_only=False).astype(bool)
            for words, (keys, n) in ((False, _window_counts(_texts(text), taught)), (True, _word_counts(text, taught))):
                of, order, first = _dealt(keys, buckets, words)
                cut = first[1:]
                parts = [_pack_keys(x) for x in np.split(keys[order], cut)], [_pack(x) for x in np.split(n[order].astype("i4"), cut)]
                yield rows(block=pa.array(np.full(of.size, block)), bucket=pa.array(of, pa.int32()), keys=pa.array(parts[0], pa.binary()), n=pa.array(parts[1], pa.binary()))

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype("i8") + 64)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = min(batch.num_rows, int(np.searchsorted(ends, before + block_bytes - size, "left")) + 1)
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= block_bytes:
                    yield from given()
                    block, held, size = block + 1, [], 0
        if held:
            yield from given()

    return texts.mapInArrow(run, "block long, texts binary, bucket int, keys binary, n binary")


def score_documents(docs: DataFrame, held_out: int = 2, folds: int = 7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Texts (null: empty) are scored whole, A-Z in lower case. ``score`` is log10 of the context
    tree's probability of the bytes and the end; ``base_score`` that of the tokens by add-one word
    frequencies. Both learn from documents whose crc32(doc_id as text) mod ``folds`` is not ``held_out`` (null
    ids count as the empty text). Word counts and the tree stay distributed: each block of about
    ``block_bytes`` of texts gives its words and windows once, sorted, and gets back the counts and logs of just these.
    Rows that repeat are rows of their own; extra columns are not read; doc_id is taken as a long.
    """
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_out
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    # fewer than the blocks where these are many: else the parts, one for each of both, would grow with the square of the texts
    buckets = min(blocks, 16 * math.isqrt(blocks) + 16)
    both = materialise(_blocks(texts, buckets, block_bytes), "blocks")
    parts = both.where("bucket IS NOT NULL")
    merged = materialise(_merged(parts), "merged")
    words, windows = merged.where(F.col("bucket") >= buckets), merged.where(F.col("bucket") < buckets)
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    tables = materialise(window_logs(windows).unionByName(words.select("bucket", "keys", F.col("n").alias("values"))), "tables")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = pa.ipc.open_stream(left.column("texts")[0].as_buffer()).read_all().combine_chunks()
        text = left.column("text").chunk(0)
        of = right.column("bucket").to_numpy()
        packed = right.column("values").to_pylist()
        at = np.argsort(of)
        logs = np.concatenate([np.zeros(0, "f4"), *(_unpack(packed[i], "f4") for i in at if of[i] < buckets)])
        counts = np.concatenate([np.zeros(0, "i8"), *(_unpack(packed[i], "i8") for i in at if of[i] >= buckets)])
        raw = _texts(text)
        strips = list(_strips(raw)) if sum(map(len, raw)) < 2 * STRIP else None
        keys = _summed(*zip(*((k, np.zeros(k.size)) for k, _ in (_runs(w) for _, w in strips or _strips(raw))), strict=True))[0]
        in_order = np.empty(keys.size, "f4")
        in_order[_dealt(keys, buckets, False)[1]] = logs
        whole = np.zeros(len(raw))
        for first, windows in strips or _strips(raw):
            own, begins = _runs(windows)
            value = in_order[np.searchsorted(keys, own)] if own.size < keys.size else in_order
            each = np.repeat(value.astype("f8"), np.diff(begins, append=windows.size))
            sums = np.bincount((windows & np.uint64(0xFFFF)).astype("i8"), each)
            whole[first : first + sums.size] += sums
        own, place, owner = _tokens(text)
        listed = np.union1d(own, np.array([END], "u8"))
        c = np.empty(listed.size, "i8")
        c[_dealt(listed, buckets, True)[1]] = counts
        token, end = c[np.searchsorted(listed, own)][place], c[np.searchsorted(listed, np.uint64(END))]
        log = np.log10((c[np.searchsorted(listed, own)] + 1.0) / (total + distinct + 1))[place]
        n = len(raw)
        columns = {
            "doc_id": left.column("doc_id"),
            "held_out": left.column("held_out"),
            "n_tokens": pa.array(np.bincount(owner, minlength=n) + 1),
            "n_known": pa.array(np.bincount(owner, token > 0, n).astype("i8") + int(end > 0)),
            "base_score": pa.array(np.bincount(owner, log, n) + math.log10((end + 1) / (total + distinct + 1))),
            "score": pa.array(whole),
            "n_bytes": pa.array(np.fromiter(map(len, raw), "i8", n)),
        }
        return pa.table(columns)

    scored = (
        both.where("bucket IS NULL").select("block", "texts").groupBy("block").cogroup(_looked_up(parts, tables, buckets).groupBy("block"))
        .applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * F.log2(F.lit(10.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte")
    )
