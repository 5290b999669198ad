"""Passages that repeat across documents, located by Aho-Corasick automata of recurring phrases.

Four passes, each linear in its input:

1. Every document is cut in words and winnowed: of the phrases of ``PHRASE`` words in each window the one with
   the least hash is kept, so equal windows keep equal phrases. Phrases of two or more documents recur; a document without any
   holds no repeated window and is done.
2. Recurring passages are confirmed: the windows around recurring phrases are grouped by their hashes, and the first document
   of each window that later documents have is its owner. Neighbouring windows of an owner make a passage.
3. The passages' texts are read from their owners and sent to the blocks of documents that hold any of their windows.
4. Each block compiles the phrases of its passages into an automaton and streams its documents through it. Each
   occurrence found is compared with the passage word by word; runs of a whole window or more are spans to remove.

So an automaton is as large as one block's passages, however large the corpus, and spans rest on words, not on hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.minhash import BROADCAST_IDS, _mix, _streamed
from tallyloom.llm.store import materialise, slices

WINDOW = 50
PHRASE = 20
#: Bytes of all texts for each block of documents.
BLOCK_BYTES = 1 << 20
#: First words of a passage's windows lie within so many words of its owner.
PASSAGE = 256

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, "u8")
_inverses = np.ones(1, "u8")


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers, _inverses
    if n > _powers.size:
        size = 1 << n.bit_length()
        up = np.full(size, np.uint64(_BASE))
        down = np.full(size, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers, _inverses = np.cumprod(up), np.cumprod(down)
    return _powers, _inverses


class Sums:
    """Prefix sums of word hashes times powers of a base, from which the hash of any run of words is one difference."""

    def __init__(self, words: np.ndarray):
        up, self.down = _table(words.size + 1)
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(words * up[: words.size])])

    def runs(self, width: int) -> np.ndarray:
        """Hash of each run of ``width`` words."""
        n = self.sums.size - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, "u8")


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: values.size - (width - have)], values[width - have :]) if width > have else values


class Words:
    """Hashes of words, kept up to a bound."""

    def __init__(self, most: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], "u8")
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], "u8")


def _winnowed(counts: list[int], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another (``counts`` words each): where windows begin, whose they are, and each one's least phrase."""
    ends = np.cumsum(counts)
    if words.size < WINDOW:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
    low = least(Sums(words).runs(PHRASE), WINDOW - PHRASE + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(low.size)
    inside = at + WINDOW <= ends[owner[: low.size]]
    return at[inside], owner[: low.size][inside], low[inside]


def _first_pass(docs: DataFrame, texts: bool) -> DataFrame:
    """doc_id, n_words, n_bytes, kept_sha256 of all words, phrases (distinct, of its windows), kept (all words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            for at, n in slices(batch.column(1), 1 << 20):
                ids, raw = batch.column(0).slice(at, n), batch.column(1).slice(at, n).to_pylist()
                split = [(t or b"").split() for t in raw]
                joined = [b" ".join(w) for w in split]
                long = [i for i, w in enumerate(split) if len(w) >= WINDOW and ids[i].is_valid]
                phrases: list[np.ndarray] = [np.zeros(0, "i8")] * n
                if long:
                    _, owner, low = _winnowed([len(split[i]) for i in long], np.concatenate([hashed(split[i]) for i in long]))
                    new = np.ones(low.size, bool)
                    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                    owner, low = owner[new], low[new].view("i8")
                    for i, part in zip(long, np.split(low, np.searchsorted(owner, np.arange(1, len(long)))), strict=True):
                        phrases[i] = np.unique(part)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(w) for w in split], pa.int64()), pa.array([len(t or b"") for t in raw], pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined]), pa.array(phrases, pa.list_(pa.int64())), pa.array([j.decode("utf-8", "replace") if texts else None for j in joined], pa.string())],
                    names=["doc_id", "n_words", "n_bytes", "kept_sha256", "phrases", "kept"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_bytes long, kept_sha256 string, phrases array<bigint>, kept string")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids(doc_id)``. Up to BROADCAST_IDS ids are broadcast, more are shuffled."""
    ids = materialise(ids.distinct(), "picked")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _windows(rows: DataFrame) -> DataFrame:
    """The windows around recurring phrases of each block. ``rows(block, kind, a, text)``: kind 0 with a phrase, kind 1 with a
    document. Gives h, doc_id, pos, more: each window's hash, the first of the block's documents that has it, where it begins
    there, and whether the block has it in a later document too."""
    hashed = Words()

    def use(table: pa.Table) -> pa.RecordBatch | None:
        kind, a = table.column("kind").to_numpy(), table.column("a").to_numpy()
        phrases = np.unique(a[kind == 0]).view("u8")
        phrases.sort()
        split = [t.split() for t in table.column("text").filter(pa.array(kind == 1)).to_pylist()]
        if not phrases.size or not split:
            return None
        counts = [len(w) for w in split]
        words = np.concatenate([hashed(w) for w in split])
        at, owner, low = _winnowed(counts, words)
        place = np.minimum(np.searchsorted(phrases, low), phrases.size - 1)
        hit = phrases[place] == low
        at, owner = at[hit], owner[hit]
        if not at.size:
            return None
        h = Sums(words).runs(WINDOW)[at].view("i8")
        doc, pos = a[kind == 1][owner], at - (np.cumsum(counts) - counts)[owner]
        order = np.lexsort((pos, doc, h))
        h, doc, pos = h[order], doc[order], pos[order]
        firsts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lasts = np.append(firsts[1:], h.size) - 1
        return pa.RecordBatch.from_arrays([pa.array(h[firsts]), pa.array(doc[firsts]), pa.array(pos[firsts]), pa.array(doc[lasts] != doc[firsts])], names=["h", "doc_id", "pos", "more"])

    return _streamed(rows, ["block"], ["kind"], use, "h long, doc_id long, pos long, more boolean")


def _passages(rows: DataFrame) -> DataFrame:
    """Texts of the wanted passages. ``rows(block, kind, a, slot, lo, hi, text)``: kind 0 wants the words from lo up to the window
    at hi of document a, kind 1 is a document. Documents with one id each give theirs."""

    def use(table: pa.Table) -> pa.RecordBatch | None:
        docs: dict[int, list[list[bytes]]] = {}
        out = []
        for r in table.select(["kind", "a", "text"]).filter(pa.array(table.column("kind").to_numpy() == 1)).to_pylist():
            docs.setdefault(r["a"], []).append(r["text"].split())
        for r in table.select(["kind", "a", "slot", "lo", "hi"]).filter(pa.array(table.column("kind").to_numpy() == 0)).to_pylist():
            for words in docs.get(r["a"], ()):
                if len(part := words[r["lo"] : r["hi"] + WINDOW]) >= WINDOW:
                    out.append((r["a"], r["slot"], b" ".join(part)))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["owner", "slot", "passage"])

    return _streamed(rows, ["block"], ["kind"], use, "owner long, slot long, passage binary")


class Automaton:
    """The phrases of passages as an automaton, and the passages' words to compare with."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        self.reach = WINDOW - PHRASE
        gap = np.full(WINDOW, -1, "i8")
        parts, owners, phrases = [gap], [np.zeros(WINDOW, "i8")], {}
        at = WINDOW
        for owner, text in passages:
            words = text.split()
            own = self.number(words)
            runs = Sums(_mix(own.view("u8") + np.uint64(_BASE))).runs(PHRASE)
            chosen = np.flatnonzero(np.isin(runs, least(runs, self.reach + 1)))
            for p in chosen.tolist():
                phrases.setdefault(b" %b " % b" ".join(words[p : p + PHRASE]), []).append(at + p)
            parts += [own, gap]
            owners.append(np.full(own.size + gap.size, owner, "i8"))
            at += own.size + gap.size
        self.words, self.owners = np.concatenate(parts), np.concatenate(owners)
        self.automaton = ahocorasick.Automaton()
        #: Of each phrase: its length, and where it begins in the passages.
        self.places: list[tuple[int, np.ndarray]] = []
        for phrase, where in phrases.items():
            self.automaton.add_word(phrase.decode("latin-1"), len(self.places))
            self.places.append((len(phrase), np.array(where)))
        self.automaton.make_automaton()

    def number(self, words: list[bytes]) -> np.ndarray:
        known = self.ids
        return np.fromiter((known.setdefault(w, len(known)) for w in words), "i8", len(words))

    def spans(self, doc: int, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, number of words) of the runs of ``words`` covered by windows that documents before ``doc`` have."""
        if len(words) < WINDOW or not self.places:
            return []
        begins = np.cumsum([1, *[len(w) + 1 for w in words[:-1]]])
        ends, which = [], []
        for end, i in self.automaton.iter((b" %b " % b" ".join(words)).decode("latin-1")):
            ends.append(end)
            which.append(i)
        if not ends:
            return []
        sizes = np.array([self.places[i][0] for i in which])
        at = np.searchsorted(begins, np.array(ends) - sizes + 2)
        mine = np.concatenate([np.full(WINDOW, -2, "i8"), self.number(words), np.full(WINDOW, -2, "i8")])
        gone = np.zeros(len(words) - WINDOW + 1, bool)
        which_, turn, reach = np.array(which), 0, self.reach
        near = np.arange(-reach, PHRASE + reach)
        while at.size:
            # each occurrence with the next place that its phrase has in the passages
            lists = [self.places[i][1] for i in which_.tolist()]
            more = np.array([len(x) > turn for x in lists])
            # windows around it that are settled need no more comparing
            before = np.concatenate([[0], np.cumsum(~gone)])
            lo, hi = np.maximum(at - reach, 0), np.minimum(at, gone.size - 1) + 1
            more &= before[hi] > before[np.minimum(lo, hi)]
            at, which_ = at[more], which_[more]
            place = np.array([x[turn] for x, m in zip(lists, more, strict=True) if m], "i8")
            turn += 1
            if not at.size:
                break
            earlier = self.owners[place] < doc
            p, o = at[earlier], place[earlier]
            for k in range(0, p.size, 4096):
                one, two = p[k : k + 4096], o[k : k + 4096]
                same = mine[one[:, None] + WINDOW + near] == self.words[two[:, None] + near]
                left = np.cumprod(same[:, reach - 1 :: -1], 1).sum(1) if reach else np.zeros(one.size, "i8")
                right = np.cumprod(same[:, reach:], 1).sum(1)
                long = (left + right >= WINDOW) & (right >= PHRASE)
                for s, e in zip((one - left)[long].tolist(), (one + right)[long].tolist(), strict=True):
                    gone[s : e - WINDOW + 1] = True
        change = np.zeros(len(words) + 1, "i8")
        starts = np.flatnonzero(gone)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WINDOW, -1)
        covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


def _located(rows: DataFrame, texts: bool) -> DataFrame:
    """Spans of each block's documents. ``rows(block, kind, a, text)``: kind 0 is a passage with its owner, kind 1 a document."""

    def use(table: pa.Table) -> pa.RecordBatch | None:
        kind, a = table.column("kind").to_numpy(), table.column("a").to_numpy()
        pick = lambda k: zip(a[kind == k].tolist(), table.column("text").filter(pa.array(kind == k)).to_pylist(), strict=True)
        automaton = Automaton(list(pick(0)))
        out = []
        for doc, text in pick(1):
            words = text.split()
            spans = automaton.spans(doc, words)
            kept, at = [], 0
            for first, n in spans:
                kept += words[at:first]
                at = first + n
            rest = b" ".join(kept + words[at:])
            out.append((doc, len(words), [{"first": f, "words": n} for f, n in spans], hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if texts else None))
        if not out:
            return None
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_words", "removed", "kept_sha256", "kept"])

    return _streamed(rows, ["block"], ["kind"], use, "doc_id long, n_words long, removed array<struct<first:bigint,words:bigint>>, kept_sha256 string, kept string")


def find_repeats(docs: DataFrame, texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, removed, kept_sha256 (and kept, with ``texts``) of each row: the spans (first word, number of words)
    that are covered by windows of WINDOW words which also start in a document with a smaller doc_id, and the SHA-256 of the other
    words, joined by single spaces.

    Words are what ASCII white space leaves, unchanged; windows are judged on the input. A null, empty or blank text has no words,
    a text of fewer than WINDOW words no windows. A row without doc_id comes before and after none, so it is kept whole
    and removes nothing. Rows with one doc_id do not remove from each other; each gives a row. Other columns are not read.
    Windows meet by 64-bit hashes on the way to their owners; spans are found by comparing words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    seen = materialise(_first_pass(rows, texts), "words")
    total = seen.agg(F.sum("n_bytes")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def block(doc: str | Column) -> Column:
        return F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int")

    phrases = seen.where("doc_id IS NOT NULL").select("doc_id", F.explode("phrases").alias("phrase"))
    recurring = materialise(phrases.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("phrase"), "phrases")
    held = materialise(phrases.join(recurring, "phrase").select("doc_id", "phrase"), "held")
    touched = held.select("doc_id").distinct()
    chosen = _picked(rows.where("text IS NOT NULL"), touched).select(block("doc_id").alias("block"), F.lit(1).alias("kind"), F.col("doc_id").alias("a"), "text")
    wanted = held.select(block("doc_id").alias("block"), F.lit(0).alias("kind"), F.col("phrase").alias("a"), F.lit(None).cast("binary").alias("text")).distinct()
    found = _windows(wanted.unionByName(chosen))
    first = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("h"))
    routes = (
        found.withColumn("f", first)
        .where((F.col("f.doc_id") < F.col("doc_id")) | F.col("more"))
        .select(block("doc_id").alias("block"), F.col("f.doc_id").alias("owner"), F.floor(F.col("f.pos") / PASSAGE).alias("slot"), F.col("f.pos").alias("pos"))
        .groupBy("block", "owner", "slot")
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    )
    routes = materialise(routes, "routes")
    needs = routes.groupBy(F.col("owner").alias("a"), "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    none = F.lit(None).cast("long")
    owners = _picked(rows.where("text IS NOT NULL"), routes.select(F.col("owner").alias("doc_id")))
    asked = needs.select(block("a").alias("block"), F.lit(0).alias("kind"), "a", "slot", "lo", "hi", F.lit(None).cast("binary").alias("text"))
    asked = asked.unionByName(owners.select(block("doc_id").alias("block"), F.lit(1).alias("kind"), F.col("doc_id").alias("a"), none.alias("slot"), none.alias("lo"), none.alias("hi"), "text"))
    passages = materialise(_passages(asked), "passages")
    sent = routes.select("block", "owner", "slot").join(passages, ["owner", "slot"]).select("block", F.lit(0).alias("kind"), F.col("owner").alias("a"), F.col("passage").alias("text"))
    located = _located(sent.unionByName(chosen), texts)
    untouched = seen.join(touched, "doc_id", "left_anti").select("doc_id", "n_words", F.array().cast("array<struct<first:bigint,words:bigint>>").alias("removed"), "kept_sha256", "kept")
    out = untouched.unionByName(located)
    return out if texts else out.drop("kept")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed of each document."""
    found = find_repeats(docs)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


#: DuckDB SQL for the digests.
SQL = f"""with words as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
starts as (select k, doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) as s from (select *, unnest(range(1, len(w) - {WINDOW - 2})) as i from words)),
firsts as (select s, min(doc_id) as first from starts group by s),
gone as (select distinct k, unnest(range(i, i + {WINDOW})) as j from starts join firsts using (s) where first < doc_id),
lists as (select k, list(j) as js, count(*) as n from gone group by k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed,
sha256(array_to_string(case when n is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda x: not list_contains(js, x)), lambda x: w[x]) end, ' ')) as kept_sha256 from words left join lists using (k)"""
