"""Secret scans: fixed patterns, and strings that a character Markov model finds random."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.numbering import fresh

#: The patterns of the kinds.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
SAMPLE_DOCUMENTS = 500
#: Digests from which the random samples are made.
RANDOM_STRINGS = 4000
#: Nats for each pair of characters by which the random model must be ahead.
MARGIN = 1.0

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None, least: int = 1) -> Column:
    """Spans of the non-overlapping matches from the left, in code points. ``keep``: for each match
    the string that needs ``least`` characters (the match itself if none is given)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(matches.alias("m"), between.alias("b"), (matches if keep is None else keep).alias("k"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,n:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["b"])
        end = begin + F.coalesce(F.length(p["m"]), F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.coalesce(F.length(p["k"]), F.lit(0)).alias("n"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.transform(F.filter(found, lambda s: s["n"] >= least), lambda s: F.struct(s["start"], s["kind"], s["end"]))


def _if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind. Cheap tests keep most texts from the patterns."""
    low = F.lower(text)
    words = [F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    any_word = words[0]
    for w in words[1:]:
        any_word = any_word | w
    assign = _if(any_word, _spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), 6))
    access = _if(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, None, 20))
    # maximal runs of 24 and more are the matches of HEX that pass
    hexes = _if(text.rlike("[0-9a-f]{24}"), _spans(text, HEX.replace("+", "{24,}"), 2, None, 24))
    return F.array_sort(F.concat(assign, access, hexes))


def train(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each pair of character classes.

    Labelled samples: random strings in the usual alphabets, made from RANDOM_STRINGS digests; and
    ordinary identifiers, made from the words of about ``sample_documents`` documents (alone, joined by ``_`` or ``-``, and in camel case), without words that have digits. Both models are
    first-order chains, smoothed by two counts spread as the single characters are. Only the counts of pairs of the 68 character
    classes reach the driver.
    """
    n = docs.count()
    if not n:
        return [0.0] * (len(ALPHABET) + 1) ** 2
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-n // sample_documents))) == 0).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    b64 = F.base64(digest)
    made = F.array(b64, F.hex(digest), F.lower(F.hex(digest)), F.translate(b64, "+/=", ""), F.upper(F.translate(b64, "+/=", "")), F.translate(b64, "+/", "-_"))
    words = F.filter(F.split("text", "[^\\p{L}\\p{N}]+"), lambda w: (F.length(w) >= 4) & ~w.rlike("[0-9]|[^A-Za-z]"))
    joint = F.array(F.lit("_"), F.lit("-"), F.lit(""), F.lit("/"))
    ordinary = F.transform(
        F.array(words), lambda ws: F.array_distinct(F.concat(ws, F.transform(ws, lambda w, i: F.concat(w, F.get(joint, i % 4), F.initcap(F.coalesce(F.get(ws, i + 1), w))))))
    )[0]
    labelled = docs.sparkSession.range(RANDOM_STRINGS).select(F.explode(made).alias("s"), F.lit(1).alias("y")).unionByName(some.select(F.explode(ordinary).alias("s"), F.lit(0).alias("y")))
    counts = (
        labelled.where(F.length("s") > 1)
        .select("y", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
        .groupBy("y", F.instr(F.lit(ALPHABET), F.substring("s", F.col("i"), F.lit(1))).alias("a"), F.instr(F.lit(ALPHABET), F.substring("s", F.col("i") + 1, F.lit(1))).alias("b"))
        .count()
        .collect()
    )
    size = len(ALPHABET) + 1
    table = np.zeros((2, size, size))
    for r in counts:
        table[r["y"], r["a"], r["b"]] += r["count"]
    single = table.sum(1) + 0.5
    single /= single.sum(1, keepdims=True)
    log = np.log((table + 2 * single[:, None, :]) / (table.sum(2, keepdims=True) + 2))
    return (log[1] - log[0]).ravel().tolist()


def random_ratio(word: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs."""
    size, weights = len(ALPHABET) + 1, F.lit(np.array(model))
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.transform(F.array(codes), lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda acc, i: acc + F.get(weights, F.get(c, i) * size + F.get(c, i + 1))) / (F.size(c) - 1))[0]
    return F.when(F.length(word) >= 2, total).otherwise(F.lit(0.0))


def random_spans(text: Column, base: Column, model: list[float], margin: float = MARGIN) -> Column:
    """Spans of long strings that the random model explains better. What a base span covers is no part of one, what stands
    beside it may be."""

    def blank(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), F.greatest(s["end"] - begin, F.lit(0))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(base, start, blank, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    word = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    spans = F.when(F.size(base) > 0, _spans(rest, CANDIDATE, 3, None, 20)).otherwise(_spans(text, CANDIDATE, 3, None, 20))
    found = F.filter(spans, lambda s: random_ratio(word(s), model) >= margin)
    return _if(text.rlike(CANDIDATE.replace("{20,}", "{20}")), found)


def scan(docs: DataFrame, model: list[float] | None = None, base: str = "_base", spans: str = "_spans") -> DataFrame:
    """The documents' columns and ``base`` and ``spans``: arrays of (start, kind, end) in code points,
    end exclusive, ordered. Null texts are empty. ``spans`` keeps all of ``base``.
    Columns of these names are replaced."""
    model = train(docs) if model is None else model
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(spans, F.array_sort(F.concat(base, random_spans(text, F.col(base), model))))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    n = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span (overlaps as one) replaced by ``mark``; n_chars follows the text.
    Documents without spans, null texts among them, are unchanged; none is dropped. Other columns stay, whatever their names."""
    base, spans = fresh(docs.columns, "_base", "_spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    text = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    changed = scan(docs, None, base, spans).withColumn("text", F.when(F.size(spans) > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
