"""Near copies: SimHash ball hashing, an exact check, and an exact way for what lies outside the ball.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of at least 4/5. Fingerprints of five-word
shingles within the ball of `simhash` give the first candidates, which are verified on the whole sets; large groups of close
copies are joined by them. At a similarity of 4/5 most pairs differ in more bits than any ball that can be hashed, so the pairs
that are still apart come from a prefix join: shingles are put in one order, rare ones first; two similar sets share
a shingle among the first fifth (and one more) of each, so only those meet, and every pair that meets is verified too. Nothing is
sampled or capped: all pairs at or over the threshold are linked, and components are closed over the links.

Equal texts are one class and cost one row. Shingles are counted in packed blocks dealt by hash; with very many counting tasks
they are dealt twice, coarsely first, so that a batch is cut into a bounded number of blocks. Any one order of shingles is right, so those that
are frequent in a sample of the classes are put last without being counted, and no task holds all rows of a shingle that most texts have.
A shingle that many classes hold in front is not paired out: unless SimHash has joined all of them, they are linked from their
sets, in one task where these are few, and else by rounds of pivots, each compared with all the others in blocks and then done with.

Defined results: words are split and lower-cased as in `simhash`; fewer than five words are one shingle; null and empty
texts, and texts of white space, are copies of each other and of nothing else; shingles and texts are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import materialize, own_columns, unused
from .simhash import SEED, components

WIDTH = 5
#: Least similarity: 4 of 5.
OVER, UNDER = 4, 5
#: Shingles that one task counts, about, and that one batch packs.
TASK_SHINGLES, BATCH_SHINGLES = 1_500_000, 1_000_000
#: Blocks that a batch is dealt to at most; with more counting tasks, blocks are dealt again.
DEAL = 4096
#: Shingles of one task that deals blocks again, and of one batch there.
DEAL_SHINGLES, DEAL_BATCH = 16_000_000, 4_000_000
#: The sample that finds frequent shingles: at least so many words, at least one of so many classes; frequent is what so many sampled classes hold.
SAMPLE_WORDS, SAMPLE_OF, FREQUENT = 2_000_000, 10_000, 64
#: Frequent shingles that are put last at most, and where they stand in the order; others are counted.
MOST_FREQUENT, LAST = 100_000, 1 << 40
#: Classes on one shingle from which they are linked from their sets.
HOT_SHINGLE = 64
#: Shingles in the sets that are linked in one task, and of one block that is compared with pivots.
LOCAL_SHINGLES, BLOCK_SHINGLES = 4_000_000, 2_000_000
#: Pivots of one block; the first round has as many for each shingle, every other one twice as many as the one before.
PIVOTS = 16


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles of one text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: as simhash.fingerprint
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends[: n - 1]], stops)), np.uint64, n))


def text_class(text: Column) -> Column:
    """Equal for equal texts, and 0 for all texts without words."""
    return F.when(F.coalesce(text.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False)), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def similar(shared: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    return UNDER * shared >= OVER * (a + b - shared)


PACKED = "task long, hashes binary, classes binary, sizes binary, counts binary"


def _task(hashes: np.ndarray, classes: np.ndarray, tasks: int, frequent: np.ndarray) -> np.ndarray:
    """The counting task of each shingle; frequent shingles are not counted and go by class, to tasks below 0."""
    dealt = (hashes % np.uint64(tasks)).astype(np.int64)
    if not len(frequent):
        return dealt
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return np.where(frequent[at] == hashes, -1 - (classes.view(np.uint64) % np.uint64(tasks)).astype(np.int64), dealt)


def _pack(task: np.ndarray, hashes: np.ndarray, owner: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """One row a task: its hashes, and the classes that own them with their sizes and counts of hashes here; owner indexes classes."""
    order = np.argsort(task, kind="stable")
    task, hashes, owner = task[order], hashes[order], owner[order]
    known, cuts = np.unique(task, return_index=True)
    columns: list[list[bytes]] = [[], [], [], []]
    for lo, hi in zip(cuts, [*cuts[1:], len(task)]):
        own = owner[lo:hi]
        runs = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(own)]
        first = own[runs[:-1]]
        for out, values in zip(columns, (hashes[lo:hi], classes[first], sizes[first], np.diff(runs).astype(np.int32))):
            out.append(values.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["task", "hashes", "classes", "sizes", "counts"])


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner, classes, sizes) of packed rows; owner indexes classes."""
    hashes, classes, sizes, counts = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("hashes", np.uint64), ("classes", np.int64), ("sizes", np.int32), ("counts", np.int32)))
    return hashes, np.repeat(np.arange(len(classes)), counts), classes, sizes


def _blocks(tasks: int, per_block: int, frequent: np.ndarray):
    """Shingles of the batches' texts, packed by blocks of per_block tasks."""

    def pack(classes: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int32)
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        return _pack(_task(hashes, classes[owner], tasks, frequent) // per_block, hashes, owner, classes, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).to_numpy(zero_copy_only=False)
            rows, sets, held = [], [], 0
            for row in np.unique(classes, return_index=True)[1]:  # copies in one batch count once
                rows.append(row)
                sets.append(shingle_set(batch.column(1)[int(row)].as_py()))
                held += len(sets[-1])
                if held >= BATCH_SHINGLES:
                    yield pack(classes[rows], sets)
                    rows, sets, held = [], [], 0
            if sets:
                yield pack(classes[rows], sets)

    return run


def _dealt_again(tasks: int, frequent: np.ndarray):
    """Packed rows of coarse blocks to packed rows of single tasks."""

    def pack(parts: list[pd.DataFrame]) -> pa.RecordBatch:
        hashes, owner, classes, sizes = _unpacked(pd.concat(parts))
        return _pack(_task(hashes, classes[owner], tasks, frequent), hashes, owner, classes, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, []
        for batch in batches:
            parts.append(batch.to_pandas())
            held += int(parts[-1]["hashes"].str.len().sum()) // 8
            if held >= DEAL_BATCH:
                yield pack(parts)
                held, parts = 0, []
        if held:
            yield pack(parts)

    return run


def _shared(frequent: np.ndarray, place: np.ndarray):
    """(class, size, hash, df) of the shingles that two or more classes hold; a frequent one has its place in the order for df."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counted = rows["task"].iloc[0] >= 0
        hashes, owner, classes, sizes = _unpacked(rows)
        order = np.argsort(hashes, kind="stable")
        if counted:
            again = np.diff(hashes[order]) == 0
            order = order[np.r_[again, False] | np.r_[False, again]]
        hashes, classes, sizes = hashes[order], classes[owner[order]], sizes[owner[order]]
        order = np.lexsort((classes, hashes))
        hashes, classes, sizes = hashes[order], classes[order], sizes[order]
        fresh = np.r_[True, (np.diff(hashes) != 0) | (np.diff(classes) != 0)][: len(hashes)]
        hashes, classes, sizes = hashes[fresh], classes[fresh], sizes[fresh]
        if counted:
            _, at, df = np.unique(hashes, return_inverse=True, return_counts=True)
            df = df[at]
        else:
            df = place[np.searchsorted(frequent, hashes)]
        return pd.DataFrame({"cls": classes, "size": sizes, "hash": hashes.view(np.int64), "df": df})[df > 1]

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(1):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py()).view(np.int64))], ["hash"])


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that FREQUENT or more of the sampled classes hold, at most MOST_FREQUENT, ascending, and their places in the order.

    The sample decides only where a shingle stands in the order, never which pairs are found.
    """
    one_of = min(SAMPLE_OF, max(1, words // SAMPLE_WORDS))
    some = docs.where(f"cls <> 0 AND pmod(xxhash64(cls), {one_of}) = 0").select("cls", "text").mapInArrow(_thinned, "cls long, text string").dropDuplicates(["cls"])
    held = some.mapInArrow(_hashes, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = held.orderBy(F.desc("n"), "hash").limit(MOST_FREQUENT).collect()
    hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], LAST - order.astype(np.int64)  # the most frequent is the last


@F.pandas_udf(T.BinaryType())
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        out.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
    return pd.Series(out, dtype=bool)


def _local_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that join these classes as all pairs would: to the first of each group, one fewer than the group has."""
    rows = rows.sort_values("cls", ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    left, links = np.arange(len(sets)), []
    while len(left):  # grow one group at a time; every class is compared from once
        front, group, left = [left[0]], left[0], left[1:]
        while front and len(left):
            probe = sets[front.pop()]
            sizes = np.array([len(sets[i]) for i in left])
            near = (UNDER * sizes >= OVER * len(probe)) & (UNDER * len(probe) >= OVER * sizes)
            some = left[near]
            if len(some):
                held = np.isin(np.concatenate([sets[i] for i in some]), probe)
                near[near] = similar(np.add.reduceat(held, np.r_[0, np.cumsum(sizes[near])[:-1]], dtype=np.int64), len(probe), sizes[near])
                front += left[near].tolist()
                links += [(group, i) for i in left[near]]
                left = left[~near]
    cls = rows["cls"].to_numpy()
    return pd.DataFrame({"a": cls[[a for a, _ in links]], "b": cls[[b for _, b in links]]}, dtype="int64")


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a block's classes to pivots of other roots, as many as join what they join."""
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    sizes, cls, pivot = np.array([len(s) for s in sets]), rows["cls"].to_numpy(), rows["pivot"].to_numpy()
    labels, links = rows["root"].to_numpy().copy(), []
    for p in np.flatnonzero(pivot):
        for i in np.flatnonzero((UNDER * sizes >= OVER * sizes[p]) & (UNDER * sizes[p] >= OVER * sizes) & ~pivot):
            if labels[i] != labels[p] and similar(np.isin(sets[i], sets[p], assume_unique=True).sum(), sizes[p], sizes[i]):
                links.append((cls[p], cls[i]))
                labels[labels == labels[i]] = labels[p]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _pivoted(hot: DataFrame, sets: DataFrame, found: DataFrame, block_shingles: int) -> DataFrame:
    """`found`, and links that join all similar classes of one hash in `hot` (hash, cls, size).

    Each round compares some pivots of a hash with all its classes and is done with these pivots; a hash whose classes have become
    one component is done. A task holds PIVOTS sets and a block of about block_shingles. Where hardly any classes of a hash are similar, every one
    of them is a pivot in the end.
    """
    left, pivots = hot, PIVOTS
    while True:
        roots = components(found).select(F.col("node").alias("cls"), "root")
        rooted = left.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        open_ = rooted.groupBy("hash").agg(F.sum("size").alias("weight"), F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most")
        open_ = open_.select("hash", F.ceil(F.col("weight") / block_shingles).cast("int").alias("blocks"))
        left = materialize(rooted.join(open_, "hash"), "near-left")
        if left.isEmpty():
            return found
        rank = F.row_number().over(Window.partitionBy("hash").orderBy(F.xxhash64("cls"), "cls"))
        chosen = materialize(left.withColumn("rank", rank).where(F.col("rank") <= pivots).withColumn("chunk", F.expr(f"(rank - 1) div {PIVOTS}")), "near-pivots")
        chunks = chosen.groupBy("hash").agg(F.max("chunk").alias("last"))
        members = left.join(chunks, "hash").select("hash", "cls", "root", F.expr("pmod(xxhash64(cls), blocks)").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"), F.lit(False).alias("pivot"))
        probes = chosen.select("hash", "cls", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), "chunk", F.lit(True).alias("pivot"))
        met = members.unionByName(probes).join(sets, "cls").groupBy("hash", "block", "chunk").applyInPandas(_compared, "a long, b long")
        found = materialize(found.unionByName(met).distinct(), "near-joined")
        left = left.join(chosen.select("hash", "cls"), ["hash", "cls"], "left_anti").select("hash", "cls", "size")
        pivots *= 2


def fronts(docs: DataFrame, task_shingles: int = TASK_SHINGLES, deal: int = DEAL) -> DataFrame:
    """(cls, size, hash, at) of every class's first shingles that others hold too; at counts from 0 in the common order."""
    words = docs.select(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).first()["n"] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // task_shingles))
    frequent, place = frequent_shingles(docs, words)
    per_block = -(-tasks // deal)
    packed = docs.where("cls <> 0").select("cls", "text").mapInArrow(_blocks(tasks, per_block, frequent), PACKED)
    if per_block > 1:
        parts = -(-words // (deal * DEAL_SHINGLES))  # a block's rows are many tasks' rows: they are dealt again by as many
        salted = packed.withColumn("part", F.pmod(F.xxhash64("hashes"), F.lit(parts)))
        again = salted.repartition(2 * deal * parts, "task", "part").sortWithinPartitions("task").drop("part")
        packed = again.mapInArrow(_dealt_again(tasks, frequent), PACKED)
    shared = packed.groupBy("task").applyInPandas(_shared(frequent, place), "cls long, size int, hash long, df long")
    held = shared.groupBy("cls", "size").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("held"))
    alone = F.col("size") - F.size("held")  # shingles of no other class come first in the order
    front = F.col("size") - F.ceil(F.col("size") * OVER / UNDER).cast("int") + 1
    first = held.withColumns({"alone": alone, "front": front}).where("front > alone")
    return first.select("cls", "size", "alone", F.posexplode(F.slice("held", 1, F.col("front") - F.col("alone")))).select("cls", "size", F.col("col.hash").alias("hash"), (F.col("alone") + F.col("pos")).alias("at"))


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class in a batch: of a text that many documents hold, few rows are left to shuffle."""
    for batch in batches:
        first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)[1]
        yield batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the wanted classes."""
    few = docs.select("cls", "text").mapInArrow(_thinned, "cls long, text string")
    return materialize(few.join(wanted.distinct(), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", _sets("text").alias("shingles")), "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a, b = (sets.select(F.col("cls").alias(c), F.col("shingles").alias("of_" + c)) for c in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").where(_similar("of_a", "of_b")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls"))


def close_links(docs: DataFrame) -> DataFrame:
    """(a, b) over the classes: links inside the SimHash ball of five-word fingerprints, as stars, where the sets are similar."""
    prints = materialize(docs.where("cls <> 0").select("cls", simhash.simhash(F.col("text"), WIDTH).alias("fp")).distinct(), "near-prints")
    least = prints.groupBy("fp").agg(F.min("cls").alias("least"))
    near = simhash.links(least.select("fp"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias("of_" + c)) for c in ("a", "b"))
    across = near.join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    pairs = materialize(across.unionByName(prints.join(least, "fp").where("cls <> least").select(F.col("least").alias("a"), F.col("cls").alias("b"))), "near-close")
    return _verified(pairs, _sets_of(docs, _ends(pairs)))


def links(docs: DataFrame, hot_shingle: int = HOT_SHINGLE, local_shingles: int = LOCAL_SHINGLES, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b) over the classes of docs (cls, text): links that join all classes whose sets are similar."""
    close = materialize(close_links(docs), "near-links")
    roots = components(close).select(F.col("node").alias("cls"), "root")
    front = materialize(fronts(docs).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "near-fronts")
    counts = front.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most").select("hash", "n", "weight")
    front = materialize(front.join(counts, "hash"), "near-shared")
    few, hot = front.where(F.col("n") <= hot_shingle), front.where(F.col("n") > hot_shingle)
    x, y = (few.select("hash", *(F.col(c).alias(c + end) for c in ("cls", "size", "at", "root"))) for end in ("_a", "_b"))
    most = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))  # what both can share if this is the first that they share
    fit = (OVER + UNDER) * most >= OVER * (F.col("size_a") + F.col("size_b"))
    pairs = x.join(y, "hash").where("cls_a < cls_b AND root_a <> root_b").where(fit).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    pairs = materialize(pairs, "near-pairs")
    sets = _sets_of(docs, _ends(pairs).unionByName(hot.select("cls")))
    found = close.unionByName(_verified(pairs, sets))
    if hot.isEmpty():
        return found
    local, large = (hot.where(side).select("hash", "cls", "size") for side in (F.col("weight") <= local_shingles, F.col("weight") > local_shingles))
    near = local.join(sets, "cls").groupBy("hash").applyInPandas(_local_links, "a long, b long")
    found = found.unionByName(near).distinct()
    return found if large.isEmpty() else _pivoted(large, sets, materialize(found, "near-found"), block_shingles)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_shingle: int = HOT_SHINGLE) -> DataFrame:
    """`docs` without the near copies: of each component the document with the least id stays, one row of it.

    Rows without an id cannot be named by one: they all stay.
    """
    known = own_columns(docs, doc_id=doc_id, text=text).select("doc_id", text_class(F.col("text")).alias("cls"), "text")
    classes = materialize(known.groupBy("cls").agg(F.min("doc_id").alias("first_id")), "near-classes")
    roots = components(links(known.select("cls", "text"), hot_shingle)).select(F.col("node").alias("cls"), "root")
    rooted = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least"))
    least = rooted.join(least, "root").where("first_id = least").groupBy("root", "least").agg(F.min("cls").alias("cls"))
    own, keep, of = (unused(docs, name) for name in ("_class", "_keep", "_cls"))
    stay = least.select(F.col("least").alias(keep), F.col("cls").alias(of))
    marked = docs.withColumn(own, text_class(F.col(f"`{text}`")))
    named = marked.join(stay, (F.col(f"`{doc_id}`") == F.col(keep)) & (F.col(own) == F.col(of)), "left_semi").dropDuplicates([doc_id, own])
    return named.drop(own).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
