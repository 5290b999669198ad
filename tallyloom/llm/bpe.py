"""Byte-level BPE by ranks: overlapping chunks of long texts are pre-tokenised in parallel."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384
OVERLAP = 512
#: The longest look ahead of the pattern past the end of a piece ("'re").
AHEAD = 3


class Bpe:
    """Ranks of byte strings, from a file with a base64 token and a rank on each line."""

    def __init__(self, lines: list[bytes], pattern: str, most: int = 1_000_000):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        # what pieces were encoded to, as decimal ids and as the bytes that these decode to
        self.shown: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.most = most

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank is joined, the leftmost first, until
        no pair has a rank."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 200:
            return self._merge_long(parts)
        none = len(self.ranks) + 1
        get = self.ranks.get
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for very long pieces, with a heap and links: n log n."""
        import heapq

        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        live: list[bytes | None] = list(parts)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if live[i] != left or j < 0 or live[j] != right:
                continue
            live[i], live[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (r := get(live[a] + live[b])) is not None:
                    heapq.heappush(heap, (r, a, live[a], live[b]))
        return [self.ranks[p] for p in live if p is not None]

    def _learn(self, pieces: list[str]) -> None:
        new = [p for p in set(pieces) if p not in self.shown]
        if len(self.shown) + len(new) > self.most:
            self.shown.clear()
            self.raw.clear()
            new = list(set(pieces))
        for p in new:
            ids = self.merge(p.encode())
            self.shown[p] = " ".join(map(str, ids))
            self.raw[p] = self.decode(ids)

    def encode_pieces(self, pieces: list[str]) -> tuple[str, bytes]:
        """Of a text given as its pieces: the decimal ids joined by spaces, and the raw bytes of the ids,
        those of each piece one after the other."""
        self._learn(pieces)
        return " ".join(map(self.shown.__getitem__, pieces)), b"".join(map(self.raw.__getitem__, pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


_known: dict[tuple[str, str], Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _known:
        with open(path, "rb") as f:
            _known[path, pattern] = Bpe(f.read().splitlines(), pattern)
    return _known[path, pattern]


def stitch(own: Bpe, text: str, chunks: list[tuple[int, int, list[int]]]) -> list[int]:
    """Starts of the pieces of ``text`` from those of its chunks (begin, end, starts), which overlap.

    A start that a chunk has in common with the true starts makes all its later ones true, but for
    those near its end, where a match could have gone on. So the next chunk takes over at the first
    start that both have; if they have none (a piece longer than the overlap), the text is read on
    from the last true start until they meet.
    """
    out = [0]
    for begin, end, starts in chunks:
        have = set(starts)
        if begin == 0:
            meet = 0
        else:
            meet = next((s for s in out[bisect_left(out, begin) :] if s in have), None)
        if meet is None:
            at = out.pop()
            for m in own.pattern.finditer(text, at):
                s = m.start()
                if s > at and s in have:
                    meet = s
                if meet is not None or s >= end:
                    break
                out.append(s)
        if meet is not None:
            del out[bisect_left(out, meet) :]
            out += starts[bisect_left(starts, meet) :]
        if end < len(text):
            while len(out) > 1 and out[-1] > end - AHEAD:
                out.pop()
    return out


def encode_documents(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text (null: empty).

    Texts up to ``chunk`` code points are encoded where they are read. Longer ones become
    overlapping chunks that are pre-tokenised in any task; the starts of a text's pieces meet again
    with the text and are stitched, encoded and decoded. Rows with the same id and text keep their
    number, but of a long text's copies each task sends one on, with how many it had. doc_ids are taken as longs; a null id
    stays null. Very long pieces take n log n. Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = schema.replace(",", " ").split()[::2]
    sent = ["doc_id", "text_id", "k", "begin", "part", "starts", "n"]

    def digest(own: Bpe, pieces: list[str]) -> tuple[int, str, str]:
        ids, raw = own.encode_pieces(pieces)
        return ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(ranks, pattern)
        for batch in batches:
            rows = [digest(own, own.pattern.findall(t)) for t in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(ranks, pattern)
        copies: dict[tuple, int] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_id", "k")), strict=True))
            new = []
            for key in keys:
                new.append(key not in copies)
                copies[key] = copies.get(key, 0) + 1
            part = batch.filter(pa.array(new, pa.bool_()))
            starts = [(np.array(own.starts(t), "i4") + b).tolist() for b, t in zip(part.column("begin").to_pylist(), part.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(starts, pa.list_(pa.int32())), pa.array([1] * part.num_rows, pa.int64())], names=sent)
        more = [(*key, n - 1) for key, n in copies.items() if key[2] == 0 and n > 1]
        if more:
            ids, texts_, ks, ns = zip(*more, strict=True)
            none = [None] * len(more)
            kinds = [(ids, pa.int64()), (texts_, pa.int64()), (ks, pa.int32()), (none, pa.int32()), (none, pa.string()), (none, pa.list_(pa.int32())), (ns, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in kinds], names=sent)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        own = bpe(ranks, pattern)
        copies = int(rows.n[rows.k == 0].sum())
        rows = rows[rows.part.notna()].drop_duplicates("k").sort_values("k")
        text, end = "", 0
        parts = []
        for begin, part, starts in zip(rows.begin.astype(int), rows.part, rows.starts, strict=True):
            text += part[end - begin :]
            end = begin + len(part)
            parts.append((begin, end, list(starts)))
        at = stitch(own, text, parts)
        out = digest(own, [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)])
        return pd.DataFrame([(rows.doc_id.iloc[0], *out)] * copies, columns=names).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = texts.where(F.length("text") <= chunk).mapInArrow(whole, schema)
    step = chunk - overlap
    long = (
        texts.where(F.length("text") > chunk)
        .select("doc_id", F.xxhash64("text").alias("text_id"), "text", F.posexplode(F.sequence(F.lit(0), ((F.length("text") - overlap - 1) / step).cast("int"))).alias("k", "_"))
        .select("doc_id", "text_id", "k", (F.col("k") * step).alias("begin"), F.substring("text", F.col("k") * step + 1, F.lit(chunk)).alias("part"))
    )
    stitched = (
        long.mapInArrow(cut, "doc_id long, text_id long, k int, begin int, part string, starts array<int>, n long")
        .groupBy("doc_id", "text_id")
        .applyInPandas(meet, schema)
    )
    return short.unionByName(stitched)
