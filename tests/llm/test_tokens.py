import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyloom.llm import bpe, wavelet

ODD = [
    (5, "plain words here, and more."), (1, ""), (2, None), (9, "  two  spaces\n\n\tand tabs \n x"), (7, "don't we'll I'M 'tis x's"), (3, "naïve Ελλάδα 漢字テスト emoji 👍🏽 end"),
    (11, "a" * 3000), (12, " " * 900 + "x" + "\n" * 700), (13, "\x1c\x1d mixed\x85space wide nbsp"), (4, "x<|endoftext|>y <|endoftext|>"), (20, ("lorem ipsum dolor's " * 400)), (21, "1234567890" * 50 + "²³Ⅷ½"),
    (22, "!!!???---" * 120), (23, "’‘“”…—" * 40), (30, "é combining ﬁ"), (31, "١٢٣ arabic"), (5, "plain words here, and more."), (None, "no id"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, start string, n_tokens int")


def test_token_files(spark):
    rows = [r for r in ODD if r[0] is not None]
    got = wavelet.encode_documents(frame(spark, rows), P.path("byte_bpe_50k.json")).collect()
    tokenizer, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == want


def test_no_documents(spark):
    assert wavelet.encode_documents(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_documents(frame(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("top", [0, 1, 5, 300, 50_000, 70_000])
def test_wavelet_matrix(top):
    ids = np.random.default_rng(top).integers(0, top + 1, 3000).astype("u4")
    m = wavelet.WaveletMatrix.of(ids)
    assert (m.all() == ids).all()
    assert [m.access(i) for i in (0, 7, 511, 512, 1025, 2999)] == ids[[0, 7, 511, 512, 1025, 2999]].tolist()
    for v in {int(ids[0]), int(ids[-1]), top, top + 1}:
        places = np.flatnonzero(ids == v)
        assert [m.rank(v, e) for e in (0, 600, 3000)] == [(places < e).sum() for e in (0, 600, 3000)]
        assert [m.select(v, k) for k in range(min(3, len(places)))] == places[:3].tolist() and m.select(v, len(places)) == -1


def test_lookup_reads_the_files(spark, tmp_path):
    wavelet.write(frame(spark, [(1, "a b a"), (2, "a")]), P.path("byte_bpe_50k.json"), str(tmp_path / "w"))
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode("a", add_special_tokens=False).ids[0]
    assert [(r["n"], r["first"]) for r in wavelet.lookup(spark, str(tmp_path / "w"), a).collect() if r["n"]] == [(2, 0)]


@pytest.mark.parametrize("chunk, overlap", [(16384, 512), (100, 20), (60, 4)])
def test_bpe_is_tiktoken(spark, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in ODD:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encode_documents(frame(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk, overlap).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_token_files_of_many_shards_and_segments(spark, tmp_path, monkeypatch):
    """Starts go on across segments, shards and runs of shards."""
    monkeypatch.setattr(wavelet, "RUN", 3)
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(rng.choice(["alpha", "beta", "gamma"], rng.integers(1, 60)))) for i in rng.permutation(300)] + [(7, "again"), (7, "again")]
    got = wavelet.encode_documents(frame(spark, rows), P.path("byte_bpe_50k.json"), shard_bytes=2000, segment=100).collect()
    tokenizer, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for i, t in sorted(rows):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == want
    wavelet.write(frame(spark, rows), P.path("byte_bpe_50k.json"), str(tmp_path / "w"), shard_bytes=2000, segment=100)
    files = spark.read.parquet(str(tmp_path / "w"))
    assert files.select("shard").distinct().count() > 6 and files.where("segment > 1").count() > 0


def test_select_is_the_inverse_of_rank():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.zeros(1500, "u4"), rng.choice(np.array([3, 5, 1000], "u4"), 1500), np.full(1100, 5, "u4")])
    m = wavelet.WaveletMatrix.of(ids)
    for v in (0, 3, 5, 1000):
        places = np.flatnonzero(ids == v)
        for k in {0, 1, len(places) // 2, len(places) - 1}:
            assert m.select(v, k) == places[k] and m.rank(v, int(places[k])) == k
    assert m.select(7, 0) == m.select(-1, 0) == m.select(1 << 20, 0) == -1


def test_bpe_counts_copies_of_long_texts(spark):
    """Whole-number ids of any width; rows with one id and one long text keep their number, whatever tasks they are in."""
    text = "many words, many copies. " * 300
    rows = [(4, text)] * 7 + [(4, text + "other"), (5, text), (6, None), (6, None)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id int, text string").repartition(3)
    got = bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 500, 50).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, len(own.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == want
