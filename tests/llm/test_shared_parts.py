"""The conversation trie, repeated passages and source divergence against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallyloom.llm import divergence, repeats, trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, parent_conv_id string")


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    out = []
    for k, members in nodes.items():
        below = [n for n in nodes if n[: len(k)] == k]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
        ends = sorted(c for c in members if built[c] == k)
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(n) == len(k) + 1 for n in below), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def some_talks():
    rng = random.Random(4)
    rows = []
    for c in [*range(12), *range(100, 130), *range(205, 230), 5000]:
        opening = rng.choice(["hi", "hello there", "héé 漢字"])
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn if turn else None, rng.choice(["user", "assistant"]) if turn > 1 else "user", opening if turn < 2 else rng.choice(["a", "bb", "", None])))
    rows += [(300, 0, None, None), (300, 0, None, None), (300, 0, "user", "z" * 5000), (None, 1, "user", "lost"), (301, 1, "", "")]
    rows += [(400 + i, t, "user", "same") for i in range(40) for t in range(3)]
    rows += [(7, t, "u", str(t % 2)) for t in range(50, 90)]
    return rows


@pytest.mark.parametrize("bits", [64, 1])
def test_trie_is_the_plain_one(spark, bits, monkeypatch):
    """With one bit nearly all fingerprints collide, and verification must split them; slices are short, so scans cross them."""
    monkeypatch.setattr(trie, "SLICE", 4)
    monkeypatch.setattr(trie, "JOINED", 16)
    rows = some_talks()
    got = trie.shared_prefixes(talks(spark, rows), bits).select(*NODE).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_without_conversations_or_turns(spark):
    assert trie.shared_prefixes(talks(spark, [])).count() == 0
    assert trie.shared_prefixes(talks(spark, [(None, 1, "u", "t")])).count() == 0
    # conversation 3 takes nothing from conversation 0, which isn't there, and loses its only turn
    short = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    rows = [(short, 1, "u", "t")]
    assert [tuple(r) for r in trie.shared_prefixes(talks(spark, rows)).select(*NODE).collect()] == plain_trie(rows)
    assert plain_trie(rows)[0][:6] == (short, 0, None, 1, 0, 1)


def docs(spark, rows, kind="doc_id long, text string, n_words string, kind int"):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], kind)


def plain_repeats(rows, w=repeats.WINDOW):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), words in zip(rows, split, strict=True):
        if i is not None:
            for p in range(len(words) - w + 1):
                k = tuple(words[p : p + w])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), words in zip(rows, split, strict=True):
        gone = set()
        for p in range(len(words) - w + 1):
            if i is not None and first[tuple(words[p : p + w])] < i:
                gone |= set(range(p, p + w))
        kept = [x for p, x in enumerate(words) if p not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def some_texts():
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["lorem", "ipsum", "Dolor", "sit", "ámet", "漢字", "a", "b"]) + str(rng.randrange(40)) for _ in range(n))
    passage, other, line = say(120), say(60), say(22)
    rows = [(i, say(rng.randrange(1, 300))) for i in range(10, 30)]
    rows += [(40, passage), (41, f"{say(30)}\n{passage} {say(9)}"), (39, " ".join(passage.split()[20:75])), (38, " ".join(passage.split()[:49])), (42, f"{other}  {other}\t{say(5)}"), (43, f"{say(70)} {other}"), (2, other[5:])]
    rows += [(50 + i, f"{say(40)} {line} {say(40)} {line}") for i in range(8)]
    rows += [(60 + i, " ".join(["again"] * (45 + 3 * i))) for i in range(6)] + [(70, " ".join(["x", "y"] * 40)), (71, " ".join(["y", "x"] * 60))]
    rows += [(80, None), (81, ""), (82, " \t\n"), (83, "word"), (None, passage), (None, passage), (84, passage), (84, passage), (84, other), (85, f"{passage} {other}"), (86, f"{passage}\x85{other}\xa0tail")]
    edited = passage.split()
    edited[60] = "changed"
    rows += [(90, " ".join(edited)), (91, f"{passage} " * 30), (92, say(20_000) + " " + passage)]
    return rows


@pytest.mark.parametrize("block_bytes", [repeats.BLOCK_BYTES, 3000])
def test_repeats_are_the_plain_ones(spark, block_bytes):
    rows = some_texts()
    got = repeats.find_repeats(docs(spark, rows), texts=True, block_bytes=block_bytes).collect()
    want = plain_repeats(rows)
    assert sorted(((r["doc_id"], r["n_words"], sum(s["words"] for s in r["removed"]), r["kept_sha256"]) for r in got), key=str) == want
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert [tuple(s) for s in by_id[41]["removed"]] == [(30, 120)] and by_id[38]["removed"] == [] and by_id[None]["removed"] == []


def test_repeats_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_IDS", 3)
    rows = some_texts()
    assert sorted((tuple(r) for r in repeats.repeat_digests(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == plain_repeats(rows)


def test_no_texts_no_repeats(spark):
    assert repeats.repeat_digests(docs(spark, [])).count() == 0
    got = repeats.repeat_digests(docs(spark, [(1, "a b"), (2, None)], "doc_id int, text string, n_words string, kind int")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 2, 0), (2, 0, 0)]


def sources(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string")


def plain_divergence(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for *_, t in rows]
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), w in zip(rows, words, strict=True):
        in_docs[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang, source in {(a, b) for a, b, _ in rows}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        v = len(kept)

        def weights(*names):
            c = Counter()
            for s in names:
                c.update({t: counts[lang, s][t] for t in kept})
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept}

        others = {b for a, b, _ in rows if a == lang}
        p, q = weights(source), weights(*others)
        pairs = [(s, sum(abs(p[t] - x) for t, x in weights(s).items())) for s in others - {source}]
        terms = [(t, p[t] - q[t]) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, r) for r, (item, value) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def test_divergence_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TOGETHER", 7)
    rng = random.Random(2)
    vocabulary = ["The", "the", "naïve", "漢字", "x", "yy", "É", "é", "zeta", "don"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for lang, names in (("en", ["s1", "s2", "s3", "é", None]), ("fr", ["s1", "only"]), (None, ["s9"])):
        for s in names:
            for _ in range(rng.randrange(3, 30)):
                rows.append((lang, s, "-1 ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))))
    rows += [("en", "silent", None), ("en", "digits", "12 34"), ("de", "a", "rare"), ("de", "b", None), ("en", "s1", "the " * 5000), *[("en", "s1", "the x")] * 50]
    for least, top in ((30, 50), (5, 4)):
        got = divergence.divergences(sources(spark, rows), least, top).collect()
        assert sorted(tuple(r) for r in got) == plain_divergence(rows, least, top)
    assert divergence.divergences(sources(spark, [])).count() == 0


def test_weights_are_exact(spark):
    rows = [(10**11, 3 * 10**12, 7), (0, 0, 1), (9_223_372_036, 9_223_372_036_854, 10**6)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    assert [r[0] for r in df.select(divergence.weight("c", "n", "v")).collect()] == [1 + 1_000_000_000 * (c + 5) // (n + 5 * v) for c, n, v in rows]
