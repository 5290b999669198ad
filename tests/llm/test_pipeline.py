import random

import numpy as np

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import language_id, packing, secrets
from tallyloom.llm.store import documents
from tests.conftest import SF
from tests.llm.test_documents import near_by_force, sets_of


def test_stages_against_brute_force(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "packing"]
    given, sf = documents(spark, SF), str(tmp_path)
    odd = [(90001, "#$%&{}~|^ x" * 40, None, "s", 0), (90002, None, "en", "s", 0), (90003, "12 ½", "de", "s", 0), (90004, "", None, None, None)]
    given.unionByName(spark.createDataFrame(odd, given.schema)).write.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    path = public_tokenizers.path("piece_bpe_32k.model")
    languages, log_prob = language_id.train(documents(spark, sf), path)
    words = sorted({w for _, t in rows for w in (t or "").split()})
    even = np.full((len(log_prob), 1), -np.log(len(log_prob)))
    of = dict(zip(words, language_id.log_probabilities(words, language_id.vocabulary(path), np.hstack([log_prob, even])), strict=True))
    known = []
    for i, t in rows:
        total = sum((of[w] for w in (t or "").split()), np.zeros(len(languages) + 1))
        if t and any(map(str.isalpha, t)) and total[:-1].max() > total[-1]:
            known.append((i, t))
    assert len(known) > 0.9 * len(rows) and max(i for i, _ in known) < 90001
    kept = {i for i, _, _, k in near_by_force(known, 80) if k}
    docs = documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents(spark, sf).columns
    assert {r["doc_id"] for r in docs.collect()} == kept
    clean = secrets.redact(documents(spark, sf).where(F.col("doc_id").isin(list(kept))))
    size = {r["doc_id"]: len(r["text"].encode()) + 1 for r in clean.collect()}
    packed = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
        assert r["bin_size"] in packing.SIZES
    assert packed == size


def test_near_copies_from_four_fifths_go(spark):
    rng = random.Random(12)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([24, 50, 120]))]
        for tail in (0, 3, 4, 5, 6, 12):
            rows.append((len(rows), " ".join([*base[: len(base) - tail], *(f"x{g}.{tail}.{i}" for i in range(tail))])))
    sets = {i: sets_of(t) for i, t in rows}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    assert any(0.8 <= s < 0.85 for s in alike.values()) and any(0.7 < s < 0.8 for s in alike.values())
    best = {i: i for i in sets}
    for _ in rows:
        for (i, j), s in alike.items():
            if s >= 0.8:
                best[i] = best[j] = min(best[i], best[j])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], documents(spark, SF).schema)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert {r["doc_id"] for r in got.collect()} == {i for i in best if best[i] == i}


def test_documents_without_any_label_stay(spark):
    docs = spark.createDataFrame([(1, "plain words", None, "s", 11), (2, None, None, "s", 0), (3, "123 ?!", None, "s", 6), (4, "ü", None, None, None)], documents(spark, SF).schema)
    got = corpus_pipeline.keep_identified(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 4]
