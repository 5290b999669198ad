import math
import random
import zlib

import numpy as np
import public_tokenizers as P

from tallyloom.llm import ctw, embeddings, language_id
from tests.conftest import SF

PIECES = P.path("piece_bpe_32k.model")
WORDS = {"en": "the of and to in that with for this from", "de": "der die und nicht mit eine für auf werden sich", "fr": "les des que dans une pour est pas plus avec"}


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 40))), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, lang string, score string, held_out int")


def test_language(spark):
    rows = [*texts(150), (900, None, "en"), (901, "", "en"), (902, "123 ?!", "de"), (903, "der und nicht mit", None), (None, "les des que", "fr"), (904, "the of and " * 5000, "en"), (904, "the of and", "en")]
    got = language_id.identify(frame(spark, rows), PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        out = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == out and 0 <= r["score"] <= 1
    said = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [said[i] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "fr"]
    right = [said[i] == lang for i, _, lang in rows[:150]]
    assert sum(right) / len(right) > 0.97
    assert language_id.identify(frame(spark, []), PIECES).count() == 0
    assert [r["lang_pred"] for r in language_id.identify(frame(spark, [(1, "words", None)]), PIECES).collect()] == ["und"]


def by_force(word, number, other, log_prob, longest=16):
    """ln of the sum over all segmentations, place by place."""
    w = "▁" + word
    total = [0.0] + [-math.inf] * len(w)
    for end in range(1, len(w) + 1):
        for start in range(max(0, end - longest), end):
            piece = number.get(w[start:end], other if end - start == 1 else None)
            if piece is not None:
                a, b = sorted((total[end], total[start] + log_prob[piece]))
                total[end] = b + math.log1p(math.exp(a - b))
    return total[-1]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "A", "▁abab"]
    number = {p: i for i, p in enumerate(pieces)}
    log_prob = np.log(np.random.default_rng(0).random((10, 2)) / 5)
    words = ["abab", "bbaa", "axab", "", "ABba", "ab" * 30, "q"]
    got = language_id.log_probabilities(words, language_id.Pieces(pieces), log_prob)
    want = [[by_force(w, number, 9, log_prob[:, g]) for g in range(2)] for w in words]
    assert np.allclose(got, want)
    lattice = language_id.Lattice(words, language_id.Pieces(pieces))
    assert np.allclose(lattice.log_probability(log_prob, True), want) and np.allclose(lattice.log_probability(log_prob), want)
    long = language_id.log_probabilities(["ab" * 4000], language_id.Pieces(pieces), log_prob - 10)
    assert np.isfinite(long).all()
    use = language_id.Lattice(["ab"], language_id.Pieces(pieces)).expected(log_prob, np.zeros(1, "i8"), np.ones(1))
    assert np.allclose(use[:, 0] @ np.array([1, 2, 1, 1, 2, 3, 2, 1, 5, 1]), 3)  # pieces used cover the word's three characters


def test_languages_against_brute_force(spark):
    """The query's results on the smallest tables, from a plain scorer with the same probabilities."""
    import re

    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = docs.collect()
    learned = spark.createDataFrame([(r["text"], r["lang"]) for r in rows if not out(r["doc_id"])], "text string, lang string")
    languages, log_prob = language_id.train(learned, PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    number = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            number[sp.id_to_piece(i)] = len(number)
    assert len(log_prob) == len(number) + 1
    word = {}
    got = {r["doc_id"]: r for r in language_id.identify(docs, PIECES).collect()}
    right = []
    for r in rows:
        g, ws = got[r["doc_id"]], re.split(r"\s+", (r["text"] or "").strip())
        assert g["held_out"] == out(r["doc_id"])
        if not any(map(str.isalpha, r["text"] or "")):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        if len(r["text"]) > 1500:
            continue
        for w in ws:
            if w not in word:
                word[w] = np.array([by_force(w, number, len(number), log_prob[:, k].tolist()) for k in range(len(languages))])
        total = sum(word[w] for w in ws)
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert g["lang_pred"] == languages[int(total.argmax())] and math.isclose(g["score"], share.max(), rel_tol=1e-6)
        if g["held_out"] and r["lang"]:
            right.append(g["lang_pred"] == r["lang"])
    assert np.mean(right) > 0.95


def test_texts_of_numerals_have_no_language(spark):
    rows = [*texts(60), (900, "² ½ Ⅷ ① 123", "en"), (901, "x" * 300 + " " + "é" * 300, "fr"), (902, "THE AND", "en"), (903, "\u3000 les \x85 des\n", "fr")]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, rows), PIECES).collect()}
    assert got[900]["lang_pred"] == "und" and all(math.isfinite(r["score"]) and math.isfinite(r["margin"]) for r in got.values())
    assert got[903]["lang_pred"] == "fr" and got[903]["score"] > 0.9


def test_what_no_language_explains_goes(spark):
    rows = [*texts(150), (900, "#$%&x{}~|^" * 40, None), (901, None, "en"), (902, "12 34", None), (903, "les des que dans", None)]
    kept = language_id.keep_identified(frame(spark, rows), PIECES)
    assert kept.columns == frame(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {*range(150), 903}
    assert {r["lang"] for r in language_id.keep_identified(frame(spark, rows), PIECES, ["fr"]).collect()} == {"fr", None}


def test_context_tree_is_sequential_ctw():
    """The batch weights give the same probability of the next byte as updating bit by bit."""
    data = [b"abracadabra abracadabra", b"banana bandana", b""]
    depth = 2
    old, ctw.DEPTH = ctw.DEPTH, depth
    try:
        counts = {}
        for t in data:
            s = b"\xff" * depth + t + b"\xff"
            for i in range(depth, len(s)):
                for d in range(depth + 1):
                    code = int.from_bytes(s[i - d : i], "big") if d else 0
                    counts.setdefault((d, code), np.zeros(256))[s[i]] += 1
        levels = []
        for d in range(depth + 1):
            codes = sorted(c for k, c in counts if k == d)
            levels.append((np.array(codes, "u8"), np.array([counts[d, c] for c in codes])))
        tree = ctw.build(levels)
    finally:
        ctw.DEPTH = old
    assert np.allclose((10.0 ** tree.table.astype("f8")).sum(1), 1, atol=1e-5)

    def log_kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    def weighted(d, code, node, extra):
        """ln P_w of one bit's tree, with one more bit (context, bit) counted."""
        c = counts.get((d, code), np.zeros(256))
        bits = node.bit_length() - 1
        inside = [b for b in range(256) if (b | 256) >> (8 - bits) == node]
        z = sum(c[b] for b in inside if not b >> (7 - bits) & 1) + (extra is not None and extra[0][d] == code and not extra[1])
        o = sum(c[b] for b in inside if b >> (7 - bits) & 1) + (extra is not None and extra[0][d] == code and extra[1])
        if d == depth:
            return log_kt(z, o)
        children = {k[1] for k in counts if k[0] == d + 1 and k[1] % 256**d == code} | ({extra[0][d + 1]} if extra and extra[0][d] == code else set())
        return np.logaddexp(log_kt(z, o), sum(weighted(d + 1, k, node, extra) for k in children)) + math.log(0.5)

    for context, byte in ((b"ab", b"r"), (b"an", b"d"), (b"\xff\xff", b"a"), (b"na", b"\xff")):
        codes = [0, context[1], context[0] * 256 + context[1]]
        want = 0.0
        for bit in range(8):
            node = (byte[0] | 256) >> (8 - bit)
            want += weighted(0, 0, node, (codes, byte[0] >> (7 - bit) & 1)) - weighted(0, 0, node, None)
        row = tree.rows(np.array([codes[2]], "u8"))[0]
        assert math.isclose(tree.table[row, byte[0]] * math.log(10), want, abs_tol=1e-4)


def test_scores(spark):
    rows = [*[(i, t, lang) for i, t, lang in texts(120, 3)], (500, None, "x"), (501, "", "x"), (502, "ONE of " * 3000, "x"), (None, "the of", "x"), (5, "the of", "x")]
    got = ctw.score_documents(frame(spark, rows), block_bytes=2000).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    seen = {}
    for i, t, _ in rows:
        if not held(i):
            for w in [*(t or "").encode().lower().split(), None]:
                seen[w] = seen.get(w, 0) + 1
    total = sum(seen.values())
    want = []
    for i, t, _ in rows:
        ws = [*(t or "").encode().lower().split(), None]
        want.append((str(i), held(i), len(ws), sum(w in seen for w in ws), total, round(sum(math.log10((seen.get(w, 0) + 1) / (total + len(seen) + 1)) for w in ws), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    usual = [r["bits_per_byte"] for r in got if r["held_out"] and r["n_bytes"] > 50]
    assert np.mean(usual) < 3
    assert ctw.score_documents(frame(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(25):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 8)):
            v = centre + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.25, 0.4]) * np.linalg.norm(centre) / math.sqrt(24)
            rows.append((n, (v * rng.choice([1.0, 3.0])).astype("f4").tolist(), int(n % 3), "x"))
            n += 1
    rows += [(n, rows[0][1], None, "x"), (n + 1, None, 1, "x"), (n + 2, [0.0] * 24, 1, "x"), (n + 3, [float("nan")] * 24, 1, "x"), (n + 4, [None] + [1.0] * 23, 1, "x"), (n + 5, [1.0, 2.0], 1, "x"), (n + 6, [], 1, "x"), (n + 7, [1.0, 2.0], 1, "x")]
    ok = {r[0]: np.array(r[1], "f8") for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    near = {i: {j for j in ok if j != i and len(ok[j]) == len(v) and v @ ok[j] / (np.linalg.norm(v) * np.linalg.norm(ok[j])) >= 0.95} for i, v in ok.items()}
    best = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i, js in near.items():
            best[i] = min([best[i], *(best[j] for j in js)])
    want = {(r[0], len(near.get(r[0], ())), best[r[0]], best[r[0]] == r[0]) for r in rows}
    for tile in (4096, 17):
        assert {tuple(r) for r in embeddings.near_duplicates(vectors(spark, rows), tile=tile).collect()} == want
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_vectors_of_any_length_link(spark):
    rows = [(i, [1.0 * s, (2.0 + i / 100) * s], 1, "x") for i, s in enumerate([1e-200, 1e200, 5e-324, 1.0, 1e-310])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, 4, 0) for i in range(5)}


def test_ids_with_several_vectors_are_one_node(spark):
    rows = [(5, [1.0, 0.0], 1, "x"), (5, [0.0, 1.0], 1, "x"), (9, [1.0, 0.01], 1, "x"), (12, [0.01, 1.0], 1, "x"), (20, [-1.0, 0.5], 1, "x")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 2, 5), (5, 2, 5), (9, 1, 5), (12, 1, 5), (20, 0, 20)]


def test_bounds_are_never_below_the_cosine():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 33))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(x)
    upper = (q.astype("f8") * s[:, None]) @ (q.astype("f8") * s[:, None]).T + e[:, None] + (1 + e[:, None]) * e[None, :]
    assert (upper >= x @ x.T).all()


def test_rare_contexts_are_nodes_in_large_corpora(spark):
    """Scores are those of the whole tree: a text that occurs three times keeps all its contexts."""
    rows = [(i, f"{t} {t} {t}", lang) for i, t, lang in texts(1400, 7)] + [(2000 + i, "жзб щьъ фюя ёыэ", "x") for i in range(3)] + [(3000, "qqq ÿ unseen", "x"), (3001, None, "x")]
    depth = ctw.DEPTH
    counts = [{} for _ in range(depth + 1)]
    padded = {i: b"\xff" * depth + (t or "").encode().lower() + b"\xff" for i, t, _ in rows}
    for i, s in padded.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for at in range(depth, len(s)):
                for d in range(depth + 1):
                    counts[d].setdefault(int.from_bytes(s[at - d : at], "big"), np.zeros(256))[s[at]] += 1
    assert counts[0][0].sum() > 4 * 2**16
    tree = ctw.build([(np.array(sorted(c), "u8"), np.array([c[k] for k in sorted(c)])) for c in counts])
    for r in ctw.score_documents(frame(spark, rows), block_bytes=50_000).collect():
        s = padded[r["doc_id"]]
        before = np.array([int.from_bytes(s[at - depth : at], "big") for at in range(depth, len(s))], "u8")
        want = tree.table[tree.rows(before), list(s[depth:])].astype("f8").sum()
        assert math.isclose(r["score"], want, rel_tol=1e-4, abs_tol=1e-3), r


def test_samples_are_distinct_texts_and_no_language_is_without(spark):
    rows = [("aa", f"text {i % 3}") for i in range(60)] + [("bb", f"text {i}") for i in range(300)] + [("bb", "often")] * 200
    for most in (1, 7, 1000):
        got = [tuple(r) for r in language_id.sample(spark.createDataFrame(rows, "lang string, text string"), most).collect()]
        assert len(got) == len(set(got)) and set(got) <= set(rows)
        assert [sum(g == x for g, _ in got) for x in ("aa", "bb")] == [min(most, 3), min(most, 301)]


def test_language_of_few_distinct_texts_is_learned(spark):
    rows = [(i, ["der und nicht mit", "eine für auf werden"][i % 2], "de") for i in range(600)] + [(1000 + i, t, "en") for i, t, lang in texts(90, 5) if lang == "en"]
    for most in (2, 3, 5, 8):
        languages, log_prob = language_id.train(frame(spark, rows).select("text", "lang"), PIECES, most)
        assert languages == ["de", "en"] and all(np.ptp(np.exp(log_prob[:, g])) > 1e-3 for g in range(2))


def test_stretches_of_texts_have_the_windows_of_the_whole(monkeypatch):
    data = [b"", b"abc", b"x" * 5000, "é ü".encode() * 700, b"", b"end"]
    def per_text(strips):
        return sorted((int(w & np.uint64(0xFFFF)) + at, int(w >> np.uint64(16))) for at, ws in strips for w in ws)

    want = []
    for i, t in enumerate(data):
        s = b"\xff" * ctw.DEPTH + t + b"\xff"
        want += [(i, int.from_bytes(s[e - ctw.DEPTH : e][::-1] + s[e : e + 1], "big")) for e in range(ctw.DEPTH, len(s))]
    assert per_text(ctw._strips(data)) == sorted(want)
    monkeypatch.setattr(ctw, "STRIP", 1000)
    assert per_text(ctw._strips(data)) == sorted(want) and len(list(ctw._strips(data))) == 9
    monkeypatch.setattr(ctw, "STRIP", 1 << 20)
    assert [at for at, _ in ctw._strips([b"a"] * 70_000)] == [0, 1 << 16]


def test_tokens_are_words_between_ascii_space():
    import pyarrow as pa

    data = ["", " a  B\x0bb\x0c", "\x1ca\x85 b\xa0b", "\t\n", "A"]
    own, place, owner = ctw._tokens(pa.array(data))
    words = [(i, w) for i, t in enumerate(data) for w in t.encode().lower().split()]
    assert owner.tolist() == [i for i, _ in words] and len(own) == len({w for _, w in words})
    assert len({(int(own[p]), w) for p, (_, w) in zip(place, words, strict=True)}) == len(own)
