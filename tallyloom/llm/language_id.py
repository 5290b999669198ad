"""Language identification by unigram pieces, summed over all segmentations of the whole text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tallyloom.llm.numbering import fresh
from tallyloom.llm.store import materialise, slices

#: Distinct texts of each language, at most, that the piece probabilities are learned from.
SAMPLE_DOCUMENTS = 1000
#: Parts of a language's texts that are ranked apart before their first ones are ranked together.
SALTS = 64
ROUNDS = 3
#: Stands before each word; white space of any length is one such mark.
BEGIN = "▁"
#: Characters of words whose probabilities can't underflow as plain numbers; longer ones take logarithms.
SHORT = 24
#: Characters whose lattices are in memory together (a longer word is on its own).
AT_ONCE = 150_000
LETTER = r"\p{L}"


class Pieces:
    """The pieces of a sentencepiece model, all of them but control and byte pieces, found by the hashes
    of what they begin with. The number after them stands for any character that is no piece."""

    BITS = 19

    def __init__(self, pieces: Sequence[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), "u4")
        sizes = np.fromiter(map(len, pieces), "i8", len(pieces))
        first = np.cumsum(sizes) - sizes
        at, h = np.arange(len(pieces)), np.zeros(len(pieces), "u8")
        keys, ids = [], []
        for n in range(1, self.longest + 1):
            at, h = at[sizes[at] >= n], h[sizes[at] >= n]
            h = self.longer(h, chars[first[at] + n - 1])
            keys.append(h)
            ids.append(np.where(sizes[at] == n, at, -1))
        self.keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.ids = np.full(self.keys.size, -1, "i4")
        np.maximum.at(self.ids, place, np.concatenate(ids).astype("i4"))
        slots = (self.keys >> np.uint64(64 - self.BITS)).astype("i8")
        self.first = np.searchsorted(slots, np.arange(1 << self.BITS)).astype("i4")
        self.count = np.bincount(slots, minlength=1 << self.BITS).astype("u1")
        most = int(self.count.max())
        self.keys = np.concatenate([self.keys, np.zeros(most + 1, "u8")])
        self.ids = np.concatenate([self.ids, np.full(most + 1, -2, "i4")])

    @staticmethod
    def longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Hashes of strings with one more character."""
        h = (h ^ (c.astype("u8") + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces with these hashes; -1 where only longer ones are pieces, -2 where none is."""
        slot = (h >> np.uint64(64 - self.BITS)).astype("i8")
        at = self.first.take(slot)
        out = np.where(self.keys.take(at) == h, self.ids.take(at), np.int32(-2))
        left, k = np.flatnonzero((out == -2) & (self.count.take(slot) > 1)), 1
        while left.size:
            there = at[left] + k
            hit = self.keys.take(there) == h[left]
            out[left[hit]] = self.ids.take(there[hit])
            k += 1
            left = left[~hit & (self.count.take(slot[left]) > k)]
        return out


_vocabularies: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """One for each worker process and file."""
    if path not in _vocabularies:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _vocabularies[path] = Pieces([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])
    return _vocabularies[path]


def lettered(docs: DataFrame) -> DataFrame:
    """The documents whose texts have a letter."""
    return docs.where(F.col("text").rlike(LETTER))


class Lattice:
    """All segmentations of some words, each after the begin mark: the uses of pieces as (from, to,
    piece), grouped by the characters that stand before their ends. Places are numbered through all words."""

    def __init__(self, words: Sequence[str], pieces: Pieces):
        chars = np.frombuffer("".join(BEGIN + w for w in words).encode("utf-32-le"), "u4")
        sizes = np.fromiter(map(len, words), "i8", len(words)) + 1
        self.word = np.repeat(np.arange(len(words)), sizes + 1)  # of each place; a word has one place more than characters
        self.first = np.cumsum(sizes + 1) - sizes - 1
        self.last = self.first + sizes
        within = np.arange(chars.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - within
        place = np.repeat(self.first, sizes) + within
        at, h = np.arange(chars.size), np.zeros(chars.size, "u8")
        #: by the characters before the end: (from, to, piece) of pieces of one size
        self.steps: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(int(sizes.max(initial=0)) + 1)]
        for size in range(1, pieces.longest + 1):
            room = left[at] >= size
            if size > 1:
                at, h = at[room], h[room]
            if not at.size:
                break
            h = pieces.longer(h, chars.take(at + (size - 1)))
            found = pieces.find(h)
            use = found >= 0
            if size == 1:
                ids, of = np.where(use, found, pieces.size), at
            else:
                ids, of = found[use], at[use]
            self._add(place[of], within[of] + size, size, ids)
            live = found > -2
            at, h = at[live], h[live]

    def _add(self, start: np.ndarray, end: np.ndarray, size: int, ids: np.ndarray) -> None:
        if not start.size:
            return
        order = np.argsort(end.astype("u2") if end.max() < 1 << 16 else end, kind="stable")
        start, end, ids = start[order], end[order], ids[order]
        cuts = np.flatnonzero(np.diff(end)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), end.size], strict=True):
            self.steps[end[a]].append((start[a:b], start[a:b] + size, ids[a:b]))

    def log_probability(self, log_prob: np.ndarray, plain: bool = False) -> np.ndarray:
        """log_prob[piece, language] -> [word, language], summed over the word's segmentations. ``plain``: in numbers that
        are not logarithms, for words that are short enough."""
        if plain:
            prob = np.exp(log_prob)
            alpha = np.zeros((self.word.size, log_prob.shape[1]))
            alpha[self.first] = 1
            for step in self.steps:
                for start, end, ids in step:
                    more = alpha.take(start, 0)
                    more *= prob.take(ids, 0)
                    more += alpha.take(end, 0)
                    alpha[end] = more
            return np.log(alpha[self.last])
        return self._forward(lambda start, ids: log_prob[ids], (log_prob.shape[1],))[self.last]

    def _forward(self, weight, shape: tuple[int, ...] = ()) -> np.ndarray:
        alpha = np.full((self.word.size, *shape), -np.inf)
        alpha[self.first] = 0
        for step in self.steps:
            for start, end, ids in step:
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + weight(start, ids))
        return alpha

    def expected(self, log_prob: np.ndarray, language: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; ``language`` and number of occurrences of each word."""
        weight = lambda start, ids: log_prob[ids, language[self.word[start]]]
        alpha = self._forward(weight)
        beta = np.full(self.word.size, -np.inf)
        beta[self.last] = 0
        cells, uses = [np.zeros(0, "i8")], [np.zeros(0)]
        for step in reversed(self.steps):
            for start, end, ids in reversed(step):
                w, of = weight(start, ids), self.word[start]
                beta[start] = np.logaddexp(beta[start], beta[end] + w)
                uses.append(np.exp(alpha[start] + w + beta[end] - alpha[self.last[of]]) * n[of])
                cells.append(ids * log_prob.shape[1] + language[of])
        return np.bincount(np.concatenate(cells), np.concatenate(uses), log_prob.size).reshape(log_prob.shape)


def _together(words: Sequence[str]) -> Iterator[np.ndarray]:
    """Indices of words of like lengths, so many at a time that memory stays bounded."""
    if not len(words):
        return
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 1
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(sizes[order])
    part = np.maximum(ends // AT_ONCE, np.where(sizes[order] > SHORT, 1 + ends[-1] // AT_ONCE, 0) + ends // AT_ONCE)
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def log_probabilities(words: Sequence[str], pieces: Pieces, log_prob: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), log_prob.shape[1]))
    for group in _together(words):
        own = [words[i] for i in group]
        out[group] = Lattice(own, pieces).log_probability(log_prob, len(own[-1]) < SHORT)
    return out


def sample(known: DataFrame, most: int) -> DataFrame:
    """lang, text: of each language's distinct texts the ``most`` with the least hashes, or all if there are fewer."""
    hashed = known.select("lang", "text", F.xxhash64("text").alias("h"))
    each = hashed.select("lang", "h").distinct().withColumn("salt", F.pmod(F.hash("h"), F.lit(SALTS)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    first = each.withColumn("r", rank("lang", "salt")).where(F.col("r") <= most)
    least = materialise(first.withColumn("r", rank("lang")).where(F.col("r") <= most).select("lang", "h"), "sample")
    return hashed.join(F.broadcast(least), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, vocabulary_path: str, sample_documents: int = SAMPLE_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages and log_prob[piece, language], by expectation-maximisation over the words of
    ``sample_documents`` distinct texts of each language (all if there are fewer). ``docs``: text and
    lang. Only piece counts, bounded by the vocabulary and the languages, reach the driver."""
    spark = docs.sparkSession
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    size = vocabulary(vocabulary_path).size + 1
    log_prob = np.full((size, len(languages)), -np.log(size))
    if not languages:
        return [], log_prob

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            found: Counter = Counter()
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((g, w) for w in t.split())
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample(known, sample_documents).mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialise(words.repartition("word"), "words")
    at = {g: i for i, g in enumerate(languages)}
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(log_prob)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces = vocabulary(vocabulary_path)
            total = np.zeros_like(sent.value)
            for batch in batches:
                own, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                which = np.array([at[g] for g in batch.column(0).to_pylist()], "i8")
                for group in _together(own):
                    total += Lattice([own[i] for i in group], pieces).expected(sent.value, which[group], n[group])
            p, g = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(g, pa.int64()), pa.array(total[p, g], pa.float64())], names=["piece", "language", "n"])

        found = words.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros_like(log_prob)
        total[found.piece, found.language] = found.n
        total += 0.01
        log_prob = np.log(total / total.sum(0))
        sent.unpersist()
    return languages, log_prob


def predict(docs: DataFrame, languages: list[str], log_prob: np.ndarray, vocabulary_path: str, most: int = 300_000, out: Sequence[str] = ("_tl_lang", "_tl_score", "_tl_margin")) -> DataFrame:
    """All columns of ``docs``, then three named ``out``: _tl_lang, the language with the greatest probability of the whole text;
    _tl_score, its share of the languages' probabilities; and _tl_margin, by how many nats a character it is ahead of
    equally likely pieces. ``und``, 0 and 0 if the text is null, has no letter, or no language is known.
    A text is its words, as white space parts them, with all their characters; a word's probabilities are found once
    and kept, up to ``most`` words."""
    even = np.full((len(log_prob), 1), -np.log(len(log_prob)))
    sent = docs.sparkSession.sparkContext.broadcast(np.hstack([log_prob, even]))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = vocabulary(vocabulary_path), sent.value
        known: dict[str, int] = {}
        log = np.zeros((1024, table.shape[1]))

        def rows_of(words: list[str]) -> np.ndarray:
            """Where the words' probabilities stand."""
            nonlocal log
            new = [w for w in words if w not in known]
            if len(known) + len(new) > most:
                known.clear()
                new = words
            first = len(known)
            if first + len(new) > len(log):
                log = np.concatenate([log[:first], np.zeros((first + 2 * len(new), log.shape[1]))])
            log[first : first + len(new)] = log_probabilities(new, pieces, table)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            return np.fromiter(map(known.__getitem__, words), "i8", len(words))

        def judged(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
            parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
            ends = np.asarray(parts.offsets)[1:] - parts.offsets[0].as_py()
            coded = parts.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            distinct = coded.dictionary
            real = np.array([len(w) for w in distinct.to_pylist()], "i8")  # white space at an end gives empty words
            rows = rows_of(distinct.to_pylist())
            value = np.where(real[:, None] > 0, log.take(rows, 0), 0.0)
            letters = pc.match_substring_regex(distinct, LETTER).to_numpy(zero_copy_only=False).astype("f8")
            columns = np.column_stack([value, letters, real + (real > 0)])
            sums = np.zeros((code.size + 1, columns.shape[1]))
            np.cumsum(columns[code], 0, out=sums[1:])
            total = np.diff(sums[np.concatenate([[0], ends])], axis=0)
            own, even, has, size = total[:, :-3], total[:, -3], total[:, -2] > 0.5, total[:, -1]
            best = own.argmax(1)
            top = own[np.arange(len(own)), best]
            score = 1 / np.exp(np.maximum(own - top[:, None], -700)).sum(1)
            names = [languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
            return names, np.where(has, score, 0.0), np.where(has, (top - even) / np.maximum(size, 1), 0.0)

        for batch in batches:
            names: list[str] = []
            scores, margins = [np.zeros(0)], [np.zeros(0)]
            for at, n in slices(batch.column(place)):
                texts = batch.column(place).slice(at, n)
                if languages:
                    some, score, margin = judged(texts)
                else:
                    some, score, margin = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                names += some
                scores.append(score)
                margins.append(margin)
            added = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(margins))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *out])

    schema = StructType(list(docs.schema)).add(out[0], StringType()).add(out[1], DoubleType()).add(out[2], DoubleType())
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary_path: str, held_out: int = 2, folds: int = 4, sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin. Documents whose crc32(doc_id as text) mod ``folds`` is
    ``held_out`` teach nothing (null ids count as the empty text); predictions see the text only. See ``predict``."""
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_out
    languages, log_prob = train(docs.where(~out).select("text", "lang"), vocabulary_path, sample_documents)
    scored = predict(docs.select("doc_id", out.alias("held_out"), "text"), languages, log_prob, vocabulary_path)
    return scored.select("doc_id", "held_out", F.col("_tl_lang").alias("lang_pred"), F.col("_tl_score").alias("score"), F.col("_tl_margin").alias("margin"))


#: Nats a character by which a language must be ahead of equally likely pieces for a document to be kept.
LEAST_MARGIN = 0.0


def keep_identified(docs: DataFrame, vocabulary_path: str, wanted: Sequence[str] | None = None, least_margin: float = LEAST_MARGIN, sample_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The documents in one of the ``wanted`` languages (None: any that the labels name) that explains their text better than
    equally likely pieces do, by more than ``least_margin``. Null texts and texts without a letter go; where nothing is
    labelled, no language can be told and only they go. Other columns stay, whatever their names."""
    languages, log_prob = train(docs.select("text", "lang"), vocabulary_path, sample_documents)
    if not languages:
        return lettered(docs)
    lang, score, margin = fresh(docs.columns, "_tl_lang", "_tl_score", "_tl_margin")
    found = predict(docs, languages, log_prob, vocabulary_path, out=(lang, score, margin)).where((F.col(lang) != "und") & (F.col(margin) > least_margin))
    return (found if wanted is None else found.where(F.col(lang).isin(list(wanted)))).select(*docs.columns)
