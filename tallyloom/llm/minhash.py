"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.store import materialise, slices

WIDTH = 5
#: A prime: the slots that the elements rank. Bands have ROWS of them, or fewer where more than MISSED of the pairs would share none.
SLOTS = 127
ROWS, MISSED = 5, 1e-6
PERCENT = 85
#: By how many standard deviations a signature's estimate may fall below the similarity.
STRAY = 5
#: Members of a bucket that meet in one task; larger buckets are dealt out in pairs of such parts.
PART = 256
#: So many ids (with their sets' hashes about 50 MB) may be broadcast to pick texts; beyond that, texts and ids are shuffled.
BROADCAST_IDS = 1_000_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], "u8")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes. Words are what ASCII white space leaves, with
    A-Z in lower case; word hashes are kept up to a bound."""

    def __init__(self, most: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, "u8")
        known = self.known
        try:
            h = np.array([known[w] for w in words], "u8")
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], "u8")
        if h.size < WIDTH:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes() + b"short")], "u8")
        n = h.size - WIDTH + 1
        acc = np.zeros(n, "u8")
        for i in range(WIDTH):
            acc = _mix(acc + h[i : i + n] * _MULT[i])
        return np.unique(acc)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set, a row of SLOTS values of 16 bits; empty sets get zeros.

    An element ranks all slots by a permutation of its own (a hash-chosen affine one modulo a prime:
    its ranks of any two slots are as those of a uniform permutation, which is all that the
    estimator's mean and variance depend on). In round j each element offers the slot of rank j
    the value j + fraction. A slot filled in an earlier round can't improve, so a set stops when
    all its slots are filled: after about SLOTS ln(SLOTS) / n rounds for n elements, at most SLOTS.
    Values are hashes of the element and the round, so equal minima mean equal elements.
    """
    sizes = np.array([s.size for s in sets])
    out = np.full((len(sets), SLOTS), np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros((len(sets), SLOTS), bool)
    if not sizes.sum():
        return np.zeros((len(sets), SLOTS), "u2")
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    h = _mix(x + np.uint64(0x9E3779B97F4A7C15))
    a = (h % np.uint64(SLOTS - 1)).astype("i8") + 1
    b = ((h >> np.uint64(20)) % np.uint64(SLOTS)).astype("i8")
    for j in range(SLOTS):
        slot = (b + a * j) % SLOTS
        value = _mix(x ^ (h + np.uint64(j * 0xD6E8FEB86659FD93 % 2**64)))
        open_ = ~filled[owner, slot]
        flat = owner[open_] * SLOTS + slot[open_]
        order = np.argsort(value[open_])[::-1]
        out.reshape(-1)[flat[order]] = value[open_][order]  # the least of each slot is written last
        filled.reshape(-1)[flat] = True
        live = ~filled.all(1)
        keep = live[owner]
        if not keep.any():
            break
        if not keep.all():
            x, owner, h, a, b = x[keep], owner[keep], h[keep], a[keep], b[keep]
    sig = (_mix(out) >> np.uint64(48)).astype("u2")  # the minima themselves are small in large sets, so their own bits say little
    sig[sizes == 0] = 0
    return sig


def rows_of(percent: float) -> int:
    """Slots in a band, by the estimate for independent slots: 25 bands of 5 at 85 (4e-7 of the pairs missed), 31 of 4 at 80 (8e-8)."""
    return next((n for n in range(ROWS, 1, -1) if (1 - (percent / 100) ** n) ** (SLOTS // n) < MISSED), 1)


def least_estimate(percent: float) -> float:
    """The least estimate of a signature that allows the similarity."""
    p = percent / 100
    return p - STRAY * (p * (1 - p) / SLOTS) ** 0.5


def band_keys(sig: np.ndarray, size: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of ``size`` slots of each signature."""
    bands = SLOTS // size
    acc = np.zeros((sig.shape[0], bands), "u8") + np.arange(bands, dtype="u8") * np.uint64(0xA24BAED4963EE407)
    rows = sig[:, : bands * size].astype("u8").reshape(-1, bands, size)
    for i in range(size):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return acc.view("i8")


def sketch(docs: DataFrame, percent: float = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_id (128-bit hash of the whole set), keys (one for each band), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            for at, n in slices(batch.column(1), 1 << 20):
                sets = [shingle(t) for t in batch.column(1).slice(at, n).to_pylist()]
                sig = signatures(sets)
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array([s.size for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(list(band_keys(sig, rows_of(percent))), pa.list_(pa.int64())), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "keys", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, keys array<bigint>, sig binary")


def _possible(pairs: DataFrame, sigs: DataFrame, percent: float) -> DataFrame:
    """Pairs whose signatures allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u2").reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
                keep = (x == y).mean(1) >= least_estimate(percent)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _streamed(df: DataFrame, by: list[str], order: list[str], use: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Rows with equal ``by`` meet in one task, in order, and go to ``use`` together. Groups follow
    one another in a sorted partition, so small ones cost little and a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            keys = np.stack([table.column(c).to_numpy() for c in by])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [table.num_rows]])
            if not last:
                cuts = cuts[:-1]
            out = [use(table.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return [x for x in out if x is not None], table.slice(cuts[-1])

        for batch in batches:
            if batch.num_rows:
                out, rest = cut(pa.Table.from_batches([*held, batch]), False)
                held = rest.to_batches()
                yield from out
        if held:
            yield from cut(pa.Table.from_batches(held), True)[0]

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _first_band(sig: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """The first band of ``size`` slots in which signatures agree with one."""
    used = SLOTS // size * size
    same = (sig[:, :used] == one[:used]).reshape(-1, used // size, size).all(2)
    return same.argmax(1)


def _layout(members: DataFrame) -> DataFrame:
    """How each bucket is cut in parts: key, comp, begin, many, shared, total. A component of PART members or more has parts of its own
    (``many`` from ``begin``), the members of smaller ones share the first ``shared`` parts; the row without comp tells of the whole bucket."""
    counts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= PART
    per = F.ceil(F.col("n") / PART)
    buckets = counts.groupBy("key").agg(F.ceil(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)) / PART).alias("shared"), F.coalesce(F.sum(F.when(large, per)), F.lit(0)).alias("own"))
    buckets = buckets.select("key", "shared", (F.col("shared") + F.col("own")).alias("total"))
    before = F.sum("many").over(Window.partitionBy("key").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1))
    owned = counts.where(large).select("key", "comp", per.alias("many")).join(buckets, "key").withColumn("begin", F.col("shared") + F.coalesce(before, F.lit(0)))
    return owned.select("key", "comp", "begin", "many", "shared", "total").unionByName(buckets, allowMissingColumns=True)


def _across(members: DataFrame, docs: DataFrame, chosen: DataFrame, percent: float) -> DataFrame:
    """Links (a, b) between different components within the buckets.

    ``members(key, band, id, n, comp, sig)``. Buckets are cut in parts of about PART members, those of a large component apart from
    others, and every two parts of a bucket meet where their rows land, but for two of one component. There, pairs of different components that sizes and
    signatures allow are noted, each in the first band that both have, as positions in one row for
    the parts, never as rows. The sets of the members with such pairs then come to the same parts, and
    pairs are confirmed on them; a pair whose ends are linked by then is passed over.
    """
    parts = ["key", "i", "j"]
    layout = materialise(_layout(members.select("key", "comp")), "layout")
    shared = layout.where("comp IS NULL").select("key", "shared", "total")
    own_parts = layout.where("comp IS NOT NULL").select("key", "comp", "begin", "many")
    placed = members.join(shared, "key").join(own_parts, ["key", "comp"], "left")
    hashed = F.xxhash64("id")
    own = F.when(F.col("begin").isNotNull(), F.col("begin") + F.pmod(hashed, F.col("many"))).otherwise(F.pmod(hashed, F.greatest("shared", F.lit(1)))).cast("int")
    # parts of one component have nothing to find in each other
    others = F.filter(F.sequence(F.lit(0), F.col("total").cast("int") - 1), lambda p: F.col("begin").isNull() | (p < F.col("begin")) | (p >= F.col("begin") + F.col("many")))
    dealt = (
        placed.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "band", "id", "n", "comp", "sig")
    )

    def meet(table: pa.Table) -> pa.RecordBatch | None:
        comp = table.column("comp").to_numpy()
        if comp.size < 2 or (comp == comp[0]).all():
            return None
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        id_, n, band = table.column("id").to_numpy(), table.column("n").to_numpy(), table.column("band")[0].as_py()
        left = table.column("left").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "u2").reshape(-1, SLOTS)
        rows = np.flatnonzero(left)
        cols = rows if same else np.flatnonzero(~left)
        found = []
        for r in rows:
            c = cols[cols > r] if same else cols
            c = c[(comp[c] != comp[r]) & (np.minimum(n[c], n[r]) * 100 >= np.maximum(n[c], n[r]) * percent)]
            if c.size:
                c = c[(sig[c] == sig[r]).mean(1) >= least_estimate(percent)]
            if c.size:
                c = c[_first_band(sig[c], sig[r], rows_of(percent)) == band]
                found.append(np.stack([np.full(c.size, r), c]))
        if not found or not (pairs := np.concatenate(found, 1)).size:
            return None
        used, place = np.unique(pairs, return_inverse=True)
        key = [table.column(c).slice(0, 1).combine_chunks() for c in parts]
        return pa.RecordBatch.from_arrays([*key, pa.array([id_[used]], pa.list_(pa.int64())), pa.array([place.astype("i4").tobytes()], pa.binary())], names=[*parts, "ids", "pairs"])

    def confirm(table: pa.Table) -> pa.RecordBatch | None:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x, "u8") for x in table.column("set").to_pylist()]
        pairs = np.frombuffer(next(x for x in table.column("pairs").to_pylist() if x is not None), "i4").reshape(2, -1)
        at = dict(zip(table.column("pos").to_pylist(), range(len(ids)), strict=True))
        root = list(range(len(ids)))
        links = []
        for x, y in zip(*pairs.tolist(), strict=True):
            x, y = at[x], at[y]
            a, b = x, y
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b and _alike(sets[x], sets[y], percent):
                root[max(a, b)] = min(a, b)
                links.append((ids[x], ids[y]))
        if not links:
            return None
        return pa.RecordBatch.from_arrays([pa.array([min(v) for v in links], pa.int64()), pa.array([max(v) for v in links], pa.int64())], names=["a", "b"])

    noted = materialise(_streamed(dealt, parts, ["id"], meet, "key long, i int, j int, ids array<bigint>, pairs binary"), "noted")
    wanted = noted.select(*parts, F.posexplode("ids").alias("pos", "id"), "pairs").withColumn("pairs", F.when(F.col("pos") == 0, F.col("pairs")))
    sets = _sets(docs, wanted.select(F.col("id").alias("doc_id")), chosen)
    with_sets = wanted.join(sets.withColumnRenamed("doc_id", "id"), "id")
    return _streamed(with_sets, parts, ["pos"], confirm, "a long, b long").distinct()


def _alike(x: np.ndarray, y: np.ndarray, percent: float) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (both.size - common)


def _sets(docs: DataFrame, ids: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, set (64-bit hashes of all shingles) of the documents in ``ids(doc_id)``. Of rows with one id those count whose set is the
    one that ``chosen(doc_id, set_id)`` names; these are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                sets = [shingle(t).tobytes() for t in part.column(1).to_pylist()]
                keep = pa.array([xxhash.xxh3_128_digest(x) == i for x, i in zip(sets, part.column(2).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), pa.array(sets, pa.binary()).filter(keep)], names=["doc_id", "set"])

    ids = materialise(ids.distinct().join(chosen, "doc_id"), "ends")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").mapInArrow(run, "doc_id long, set binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, chosen: DataFrame, percent: float) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    full = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), chosen)
    left = full.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    right = full.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: float = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, linked at a similarity of ``percent``.

    A set is a text's distinct shingles of five words; with fewer words the whole sequence; null,
    empty or blank texts have an empty set, linked with nothing. Documents with equal sets form a
    class, carried by its smallest doc_id. Classes that share a band meet in two rounds: first each
    member of a bucket with one centre of it (another choice in each band), which connects
    what is alike with as many pairs as there are members; then, in the buckets that still hold
    several components, the members of different components with each other. Pairs pass the sizes, the
    signatures and then the full sets. Similar classes share a band, and pass the signatures, but
    for less than one in a million by estimate. A row without doc_id is linked with nothing: component_id null, kept. Rows with the same
    doc_id are one document: of their sets the one with the least hash (of those that aren't empty) stands for it in links, and all of
    them get its component. Extra columns are not read.
    """
    spark = docs.sparkSession
    rows = materialise(sketch(docs, percent), "sketch")
    stands = materialise(rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min("set_id").alias("set_id")), "stands")
    classes = materialise(stands.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "classes")  # written, so that Spark can split a large class in the join
    chosen = materialise(stands.join(classes, "set_id"), "chosen")
    member = materialise(rows.select("doc_id", "n_shingles").join(chosen.select("doc_id", "rep"), "doc_id", "left"), "members")
    first_of = chosen.where("doc_id = rep").select("doc_id", "set_id")
    reps = rows.select("doc_id", "n_shingles", "set_id", "keys", "sig").join(first_of, ["doc_id", "set_id"], "left_semi").dropDuplicates(["doc_id"])
    sigs = reps.select("doc_id", "sig")
    keyed = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("keys").alias("band", "key")).select("key", "band", "id", "n")
    order = F.xxhash64("key", "id")
    centre = keyed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialise(keyed.join(centre, "key").select("key", "band", "id", "n", F.col("c.id").alias("cid"), F.col("c.n").alias("cn")), "buckets")
    fits = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * percent
    star = materialise(
        buckets.where((F.col("id") != F.col("cid")) & fits(F.col("n"), F.col("cn")))
        .select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b"))
        .distinct(),
        "star",
    )
    first = materialise(_verified(materialise(_possible(star, sigs, percent), "pairs"), docs, first_of, percent), "links")
    labels = components(first)
    placed = buckets.join(labels, buckets.id == labels.node, "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    open_ = materialise(placed.join(mixed, "key", "left_semi"), "open")
    second = _across(open_.join(sigs.withColumnRenamed("doc_id", "id"), "id"), docs, first_of, percent)
    final = components(materialise(first.unionByName(second), "links"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return (
        member.join(final, member.rep == final.node, "left")
        .select("doc_id", F.col("n_shingles").cast("long"), component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, percent: float = PERCENT) -> DataFrame:
    """The documents with one of each group: that with the smallest doc_id stays. Rows that repeat both its id and its text
    go, rows with its id and another text stay."""
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, docs.doc_id.cast("long") == kept["_kept"], "left_semi")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id IS NULL"))
