"""Token ids of a corpus in wavelet-matrix files, one for each shard.

File format: a Parquet file for each shard (a range of doc_ids), a row for each segment of at
most ``SEGMENT`` ids or so (a document is never divided). A row has
``shard, segment``, ``n_ids``, ``doc_ids`` and ``lengths`` of its documents in order, and the
matrix: ``planes``, one bit vector for each bit of the ids from the highest down, which the
Parquet file holds zstd-compressed; ``zeros``, the number of 0 bits of each plane; ``ranks``, the number of 1 bits
before every ``BLOCK``-th position as little-endian uint32. In each plane, ids stand in the order
of the plane above, stably divided by that plane's bit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.lineage import scratch
from tallyloom.llm.store import slices

BLOCK = 512
SEGMENT = 1 << 20
SHARD_BYTES = 8 << 20
#: Shards that are summed together.
RUN = 1024
SCHEMA = "shard int, segment int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, planes array<binary>, zeros array<bigint>, ranks array<binary>"

#: White space of Unicode, as the byte-level pre-tokeniser has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts whose single spaces do not all stand between two characters that are no white space.
UNEVEN = f"^ | $| [{SPACE}]|[{SPACE}] "
#: The byte-level alphabet's character for a space.
SPACE_MARK = "\u0120"
#: Words that are encoded as one text.
TOGETHER = 256


def id_kind(size: int) -> str:
    """Little-endian type that holds the ids of a vocabulary."""
    return "<u2" if size <= 1 << 16 else "<u4"


class Encoder:
    """The tokenizers library on words: each is encoded once and kept, up to ``most`` of them.

    Words go to the library many at a time, joined by single spaces. The pre-tokeniser gives each such
    space to the word after it, so the ids that begin with a space tell where the words begin.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(SPACE_MARK) for i in range(self.tokenizer.get_vocab_size())])
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """words: place of each; begins: of that place in ids, and at last where the next one begins."""
        self.words: dict[str, int] = {}
        self.begins = np.zeros(1, "i8")
        self.ids = np.zeros(0, self.kind)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), self.kind), np.fromiter(map(len, found), "i8", len(found))

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words with the space before them."""
        ids, _ = self._whole([" " + " ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)])
        starts = np.flatnonzero(self.opens[ids])
        if starts.size == len(words):
            sizes = np.diff(starts, append=ids.size)
        else:
            ids, sizes = self._whole([" " + w for w in words])
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts. They are cut at single spaces between other characters, equal words are found as
        arrays, and each distinct word is looked up once. Texts with other spaces go to the library whole."""
        import pyarrow.compute as pc

        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * len(texts)
        for at in np.flatnonzero(uneven):
            out[at] = self._whole([texts[at].as_py()])[0]
        rows = np.flatnonzero(~uneven)
        if not rows.size:
            return out
        parts = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
        firsts = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
        words = parts.flatten()
        first_ids, first_sizes = self._whole(words.take(pa.array(firsts)).to_pylist())
        inner = np.ones(len(words), bool)
        inner[firsts] = False
        coded = words.filter(pa.array(inner)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > self.most:
            self._forget()
            new = distinct
        if new:
            self._learn(new)
        place = np.fromiter(map(self.words.__getitem__, distinct), "i8", len(distinct))
        ids = np.concatenate([self.ids, first_ids])
        begin, size = np.empty(len(words), "i8"), np.empty(len(words), "i8")
        code = coded.indices.to_numpy(zero_copy_only=False)
        begin[inner], size[inner] = self.begins[place][code], (self.begins[place + 1] - self.begins[place])[code]
        begin[firsts], size[firsts] = self.ids.size + np.cumsum(first_sizes) - first_sizes, first_sizes
        ends = np.cumsum(size)
        flat = ids.take(np.repeat(begin - (ends - size), size) + np.arange(ends[-1]))
        for row, one in zip(rows, np.split(flat, ends[firsts[1:] - 1]), strict=True):
            out[row] = one
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class WaveletMatrix:
    """Ids with access, rank (counting) and select (occurrences) on bit planes."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.zeros, self.packed = n, list(zeros), planes
        self.bits: dict[int, np.ndarray] = {}
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if ids.size else 0
        cur = ids.astype("<u2" if top < 1 << 16 else "<u4")
        planes, zeros, ranks = [], [], []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (cur & cur.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones)
            planes.append(packed.tobytes())
            counts = np.bitwise_count(np.pad(packed, (0, -packed.size % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype="u4") if packed.size else np.zeros(0, "u4")
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
            low, high = np.flatnonzero(~ones), np.flatnonzero(ones)
            zeros.append(low.size)
            cur = np.concatenate([cur.take(low), cur.take(high)])
        return cls(ids.size, planes, zeros, ranks)

    def plane(self, level: int) -> np.ndarray:
        if level not in self.bits:
            self.bits[level] = np.frombuffer(self.packed[level], "u1")
        return self.bits[level]

    def _ones_before(self, level: int, at: int) -> int:
        block, packed = at // BLOCK, self.plane(level)
        inside = packed[block * BLOCK // 8 : at // 8]
        rest = int(packed[at // 8]) >> (8 - at % 8) if at % 8 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(inside).sum()) + rest.bit_count()

    def access(self, at: int) -> int:
        """The id at a position."""
        out = 0
        for level in range(len(self.packed)):
            one = int(self.plane(level)[at // 8]) >> (7 - at % 8) & 1
            before = self._ones_before(level, at)
            at = self.zeros[level] + before if one else at - before
            out = out << 1 | one
        return out

    def rank(self, value: int, end: int) -> int:
        """How often an id occurs before a position."""
        lo, hi, depth = 0, end, len(self.packed)
        if value >> depth:
            return 0
        for level in range(depth):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (depth - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def _nth(self, level: int, one: int, k: int) -> int:
        """Where a plane has its k-th (from 0) bit of the kind: its block by the counts before blocks, then its place in there."""
        ones = self.ranks[level].astype("i8")
        before = ones if one else np.arange(ones.size) * BLOCK - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        inside = np.unpackbits(self.plane(level)[block * BLOCK // 8 : (block + 1) * BLOCK // 8])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(inside == one)[k - int(before[block])])

    def select(self, value: int, nth: int) -> int:
        """Where an id occurs for the nth time (from 0); -1 if it doesn't. Down the planes to where the id's run begins in the last
        order, and from its nth place back up, by select in each plane."""
        depth = len(self.packed)
        if nth < 0 or value < 0 or value >> depth:
            return -1
        lo, hi = 0, self.n
        for level in range(depth):
            a, b = self._ones_before(level, lo), self._ones_before(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (depth - 1 - level) & 1 else (lo - a, hi - b)
        if nth >= hi - lo:
            return -1
        at = lo + nth
        for level in range(depth - 1, -1, -1):
            one = value >> (depth - 1 - level) & 1
            at = self._nth(level, one, at - self.zeros[level] if one else at)
        return at

    def all(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest up."""
        cur = np.zeros(self.n, "<u4" if len(self.packed) > 16 else "<u2")
        for level in range(len(self.packed) - 1, -1, -1):
            ones = np.unpackbits(self.plane(level), count=self.n).astype(bool)
            up = np.empty_like(cur)
            z = self.zeros[level]
            up[np.flatnonzero(~ones)] = cur[:z]
            up[np.flatnonzero(ones)] = cur[z:] | cur.dtype.type(1 << (len(self.packed) - 1 - level))
            cur = up
        return cur.astype("<u4")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES, segment: int = SEGMENT) -> None:
    """Encode whole texts (null: empty), add ``end_id`` to each, and write the files under ``path``.

    Shards are ranges of doc_id of about ``shard_bytes`` of text; null ids come first, rows with
    the same id by text. One pass sizes the shards, one shuffle sorts the texts, nothing else moves.
    """
    from pyspark import TaskContext

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, part_of_shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], own.kind)
        ids: list[np.ndarray] = []
        names: list = []
        lengths: list[int] = []
        held = 0

        def row() -> pa.RecordBatch:
            m = WaveletMatrix.of(np.concatenate(ids))
            data = {"shard": shard, "segment": part_of_shard, "n_ids": m.n, "doc_ids": names, "lengths": lengths, "planes": m.packed, "zeros": m.zeros, "ranks": [r.tobytes() for r in m.ranks]}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(data.values(), kinds, strict=True)], names=list(data))

        for batch in batches:
            for at, n in slices(batch.column(1), 6 << 20):
                part = batch.slice(at, n)
                for name, one in zip(part.column(0).to_pylist(), own.encode(part.column(1)), strict=True):
                    ids += [one, end]
                    names.append(name)
                    lengths.append(len(one) + 1)
                    held += len(one) + 1
                    if held >= segment:
                        yield row()
                        ids, names, lengths, held = [], [], [], 0
                        part_of_shard += 1
        if names:
            yield row()

    rows.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def token_digests(spark, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = WaveletMatrix(r["n_ids"], r["planes"], r["zeros"], r["ranks"]).all().tobytes()
                ends = np.cumsum(np.array(r["lengths"], "i8"))
                begins = ends - np.array(r["lengths"], "i8")
                view = memoryview(ids)
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(crcs), pa.int32()), pa.array([r["segment"]] * len(crcs), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(begins), pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                    names=["shard", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SCHEMA).parquet(path)
    rows = segments.mapInArrow(decode, "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(segments), ["shard", "segment"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def segment_starts(segments: DataFrame) -> DataFrame:
    """shard, segment, first: the ids before each segment. Segments are summed within their shards, shards within runs of RUN, and only
    one row for each run meets in one task."""

    def before(of: DataFrame, within: list[str], by: str, total: str, out: str) -> DataFrame:
        w = (Window.partitionBy(*within) if within else Window).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return of.withColumn(out, F.coalesce(F.sum(total).over(w), F.lit(0)))

    slim = segments.select("shard", "segment", "n_ids", F.floor(F.col("shard") / RUN).alias("run"))
    shards = slim.groupBy("run", "shard").agg(F.sum("n_ids").alias("n"))
    runs = before(shards.groupBy("run").agg(F.sum("n").alias("n")), [], "run", "n", "_run").select("run", "_run")
    placed = before(shards, ["run"], "shard", "n", "_shard").join(runs, "run").select("shard", (F.col("_run") + F.col("_shard")).alias("_before"))
    return before(slim, ["shard"], "segment", "n_ids", "_segment").join(placed, "shard").select("shard", "segment", (F.col("_before") + F.col("_segment")).alias("first"))


def lookup(spark, path: str, value: int) -> DataFrame:
    """From the files: shard, segment, n, first, how often an id occurs in each segment and where first
    (null: nowhere). Only rank and select are used; no ids are decoded."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = WaveletMatrix(r["n_ids"], r["planes"], r["zeros"], r["ranks"])
                n = m.rank(value, m.n)
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), pa.array([r["segment"]], pa.int32()), pa.array([n], pa.int64()), pa.array([m.select(value, 0) if n else None], pa.int64())], names=["shard", "segment", "n", "first"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(find, "shard int, segment int, n long, first long")


def encode_documents(docs: DataFrame, tokenizer: str, shard_bytes: int = SHARD_BYTES, segment: int = SEGMENT) -> DataFrame:
    """Write the corpus in ascending doc_id order and return its digests as read from the files, whose shards hold about
    ``shard_bytes`` of text and segments about ``segment`` ids. No documents give files without rows and no digests. Other columns are
    not read."""
    path = scratch(docs.sparkSession, "wavelet")
    write(docs, tokenizer, path, shard_bytes=shard_bytes, segment=segment)
    return token_digests(docs.sparkSession, path)
