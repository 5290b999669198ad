"""How the sources of a language differ in their words, by joint histograms of counts.

A source's weight of a term depends on its count alone, so the difference of two sources over a term depends on the two
counts. For each pair of sources the distinct (count, count) combinations are tallied. Only terms that both have are looked at for
that; the cells with a zero are what these leave of each source's own histogram, and of the vocabulary. The difference is worked
out once for each combination and taken as often as it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import materialise

LEAST_DOCUMENTS = 30
TOP = 50
#: A weight is 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)).
SCALE, ADDED = 1_000_000_000, 5
#: Distinct terms that a task holds before it hands its counts on.
HELD = 400_000
#: Terms of a language that are tallied together, and into how many parts its terms are dealt at least.
TOGETHER, PARTS = 4096, 16
#: Letters a-z and whatever is not ASCII stay, A-Z become lower case, all else parts terms.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often and in how many documents each source has each term. Counts are added up in each
    task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, of_docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 1 << 16):
                    part = terms[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([of_docs[t] for t in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().translate(_LETTERS).split()
                if words:
                    n, of_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(words)
                    of_docs.update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from hand_on()
        yield from hand_on()

    parts = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total, cells: the terms that enough documents of their language have, with each source's count."""
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "total", "cells")


def joint_histograms(terms: DataFrame, parts: int) -> DataFrame:
    """lang, a, b, count_a, count_b, times: for each pair of sources (a before b) how many terms that both have have the two
    counts. ``parts``: into how many the terms of a language are dealt."""

    def tally(lang: str, rows: list[list[dict]]) -> Iterator[pa.RecordBatch]:
        names = sorted({c["source"] for r in rows for c in r})
        at = {s: i for i, s in enumerate(names)}
        counts = np.zeros((len(names), len(rows)), "i8")
        for t, r in enumerate(rows):
            for c in r:
                counts[at[c["source"]], t] = c["n"]
        values, codes = np.unique(counts, return_inverse=True)
        codes = codes.reshape(counts.shape)
        u, source, has = values.size, pa.array(names, pa.string()), counts > 0
        for a in range(len(names) - 1):
            # the pairs of one source with all later ones at once: a number for each other source and combination
            both = (np.arange(a + 1, len(names))[:, None] * u + codes[a]) * u + codes[a + 1 :]
            seen, times = np.unique(both[has[a] & has[a + 1 :]], return_counts=True)
            x, y = seen // u % u, seen % u
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * seen.size, pa.string()), source.take(pa.array(np.full(seen.size, a))), source.take(pa.array(seen // (u * u))), pa.array(values[x]), pa.array(values[y]), pa.array(times)],
                names=["lang", "a", "b", "count_a", "count_b", "times"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[dict]] = []
        of = None
        for batch in batches:
            for lang, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (lang != of or len(held) >= TOGETHER):
                    yield from tally(of, held)
                    held = []
                of = lang
                held.append(cells)
        if held:
            yield from tally(of, held)

    dealt = terms.select("lang", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("_part"), "cells").repartition("lang", "_part").sortWithinPartitions("lang", "_part").select("lang", "cells")
    found = dealt.mapInArrow(run, "lang string, a string, b string, count_a long, count_b long, times long")
    return found.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("times").alias("times"))


def with_zeros(joint: DataFrame, own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The tallies with their zero cells. ``own(lang, source, count, times)``: how many terms a source has so often;
    ``pairs(lang, a, b, v)``: all pairs with the size of the vocabulary. A cell's times are summed from what it gets and loses."""
    zero = F.lit(0).cast("long")

    def cells(*signed: tuple) -> Column:
        return F.inline(F.array(*[F.struct(F.col(x).alias("count_a") if x else zero.alias("count_a"), F.col(y).alias("count_b") if y else zero.alias("count_b"), (F.col(t) * s).alias("times")) for x, y, t, s in signed]))

    both = joint.select("lang", "a", "b", cells(("count_a", "count_b", "times", 1), ("count_a", "", "times", -1), ("", "count_b", "times", -1), ("", "", "times", 1)))
    of_a = pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", cells(("count", "", "times", 1), ("", "", "times", -1)))
    of_b = pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", cells(("", "count", "times", 1), ("", "", "times", -1)))
    whole = pairs.select("lang", "a", "b", cells(("", "", "v", 1)))
    every = both.unionByName(of_a).unionByName(of_b).unionByName(whole)
    return every.groupBy("lang", "a", "b", "count_a", "count_b").agg(F.sum("times").alias("times")).where("times > 0")


def weight(count: Column | str, n: Column | str, v: Column | str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (n + ADDED * v)), exactly; null where the vocabulary is empty."""
    c, n, v = (F.col(x) if isinstance(x, str) else x for x in (count, n, v))
    up = (c + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    down = F.when(v > 0, n.cast("decimal(20,0)") + v.cast("decimal(17,0)") * F.lit(ADDED).cast("decimal(1,0)"))
    return F.lit(1).cast("long") + F.call_function("div", up, down)


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of each (lang, source) that occurs, even without terms.

    Part ``pair``: the other sources of the language, the value is the sum of the differences of the weights of all kept terms (0
    without any). Part ``term``: the source's kept terms that weigh more than in the whole language, by how much, the first ``top``
    of them. Ranks count from 1 by value descending, then by item. Null text, lang and source are ''. Terms are runs of
    letters A-Z (lower-cased) and of characters beyond ASCII. Rows that repeat count as often as they occur. No documents
    give no rows. Other columns are not read. Weights are whole numbers, so sums are exact in any order.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = materialise(vocabulary(term_counts(rows), least), "terms")
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    cells = terms.select("lang", "term", "total", F.inline("cells"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    known = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v", "n_lang"])
    groups = materialise(known, "groups")
    largest = sizes.agg(F.max("v")).first()[0] or 0
    joint = joint_histograms(terms, max(PARTS, -(-largest // TOGETHER)))

    a = groups.select("lang", F.col("source").alias("a"), F.col("n").alias("n_a"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("n").alias("n_b"))
    pairs = materialise(a.join(b, "lang").where("a < b"), "pairs")
    own = cells.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count(F.lit(1)).alias("times"))
    tallies = with_zeros(joint, own, pairs.select("lang", "a", "b", "v"))
    gap = F.abs(weight("count_a", "n_a", "v") - weight("count_b", "n_b", "v"))
    summed = tallies.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(gap * F.col("times")).alias("value"))
    valued = pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").fillna(0, ["value"])
    sides = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = valued.select("lang", "value", sides)

    weighed = cells.withColumnRenamed("n", "count").join(groups, ["lang", "source"])
    more = weight("count", "n", "v") - weight("total", "n_lang", "v")
    term = weighed.where("count > 0").select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair, "pair").unionByName(ranked(term, "term").where(F.col("rank") <= top))


#: DuckDB SQL for the whole result.
SQL = f"""with docs as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
words as (select k, lang, source, unnest(w) as term from docs),
kept as (select lang, term from words group by all having count(distinct k) >= {LEAST_DOCUMENTS}),
sizes as (select lang, count(*) as v from kept group by all),
cells as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by all),
groups as (select g.lang, g.source, coalesce(sum(c), 0) as n, coalesce(any_value(v), 0) as v from (select distinct lang, source from docs) g left join cells using (lang, source) left join sizes on g.lang = sizes.lang group by all),
weights as (select g.lang, g.source, k.term, coalesce(c, 0) as c, 1 + cast({SCALE} as hugeint) * (coalesce(c, 0) + {ADDED}) // (n + {ADDED} * v) as p from groups g join kept k on g.lang = k.lang left join cells on cells.lang = g.lang and cells.source = g.source and cells.term = k.term),
whole as (select lang, term, 1 + cast({SCALE} as hugeint) * (sum(c) + {ADDED}) // (sum(sum(c)) over (partition by lang) + {ADDED} * count(*) over (partition by lang)) as q from cells group by lang, term),
pairs as (select x.lang, x.source, y.source as item, coalesce((select sum(abs(p.p - q.p)) from weights p join weights q on p.lang = q.lang and p.term = q.term where p.lang = x.lang and p.source = x.source and q.source = y.source), 0) as value from groups x join groups y on x.lang = y.lang and x.source <> y.source),
terms as (select lang, source, term as item, p - q as value from weights join whole using (lang, term) where c > 0 and p > q)
select lang, source, 'pair' as part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from pairs
union all select lang, source, 'term', item, cast(value as bigint), cast(rank as int) from (select *, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= {TOP}"""
