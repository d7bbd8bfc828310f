"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within 3 bits are linked. One of three blocks of bits is masked in turn; of three
differing bits some block holds at least one, so under that mask at most two are left. Every
fingerprint then emits all variants within half of that radius (itself and each one-bit flip), and two
linked fingerprints meet on the variant half way. Variants are shuffled, colliding fingerprints
are verified on all 64 bits, and components are closed over the verified links.

Only distinct fingerprints take part, so exact copies cost one row. A variant that many distinct
fingerprints share is not paired out in place: its rows are masked and varied once more inside the masked
block, which bounds what can meet.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and are linked
like any other; fewer than three words are one shingle; repeated rows and ties share a component;
null ids take part but never name a component unless they are alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, own_columns, unused

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Distinct fingerprints on one variant from which the variant is split further.
HOT_VARIANT = 2000
#: Most variants that one task emits.
TASK_VARIANTS = 4_000_000
CHUNK = 65_536


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text: XXH64 of every shingle, majority bit by bit."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:n]]
    stops = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(n, at + CHUNK)], stops[at:])], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def simhash(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text column over shingles of `width` words, as a long (bit 63 is the sign)."""

    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return fingerprints(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bits(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _salt(tag: int, a: int, b: int) -> int:
    """What stands in a masked block: keeps the masks' keys apart; a chance meeting fails verification."""
    return (0x9E3779B97F4A7C15 * (tag + 1)) & _bits(a, b)


def _masks(lo: int, hi: int, blocks: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """(keep, flip) of every variant of the bits lo..hi: one block of them masked, at most one other bit flipped."""
    out = []
    for tag, (a, b) in enumerate(blocks):
        keep, salt = _bits(lo, hi) & ~_bits(a, b), _salt(tag, a, b)
        out += [(keep, salt), *((keep, salt | 1 << i) for i in range(lo, hi) if not a <= i < b)]
    return out


def _variants(fp: Column, masks: list[tuple[int, int]]) -> Column:
    packed = F.split(F.lit(",".join(f"{_signed(k)} {_signed(f)}" for k, f in masks)), ",")
    table = F.transform(packed, lambda m: F.split(m, " ").cast("array<bigint>"))
    return F.explode(F.transform(table, lambda m: fp.bitwiseAND(m[0]).bitwiseXOR(m[1])))


def _local_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join these distinct fingerprints as RADIUS joins them: to each group's least, one fewer than the group has."""
    bits, root = fps.view(np.uint64), np.arange(len(fps))
    left = np.arange(len(fps))
    links = []
    while len(left):  # grow one group at a time; every fingerprint is compared from once
        front, group, left = [left[0]], left[0], left[1:]
        while front and len(left):
            near = np.bitwise_count(bits[left] ^ bits[front.pop()]) <= RADIUS
            if near.any():
                root[left[near]] = group
                front += left[near].tolist()
                left = left[~near]
    for group in np.unique(root):
        members = np.sort(fps[root == group])
        links += [(int(members[0]), int(m)) for m in members[1:]]
    return links


def _verify(batches: Iterator[pa.RecordBatch], split_over: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: links inside each key's fingerprints; keys over `split_over` go out row by row instead, as they come."""

    def out(a, b, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([hot] * len(a), pa.bool_())], ["a", "b", "hot"])

    def settle(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        links = []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            group = np.unique(fps[s:e])
            if len(group) == 2:
                if np.bitwise_count((group[:1] ^ group[1:]).view(np.uint64))[0] <= RADIUS:
                    links.append((int(group[0]), int(group[1])))
            elif len(group) > 2:
                links += _local_links(group)
        return out([a for a, _ in links], [b for _, b in links], False)

    key, held, rows, hot = None, [], 0, False  # the last key may go on in the next batch; its fingerprints are held until it is hot
    for batch in batches:
        keys, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        if not len(keys):
            continue
        for s, e in ((0, int(np.searchsorted(keys, keys[0], "right"))), (int(np.searchsorted(keys, keys[0], "right")), len(keys))):
            if s == e:
                continue
            if keys[s] != key:  # all but the last key of this stretch are whole; the stretch ends what was held
                if held and not hot:
                    yield settle(np.full(rows, key), np.concatenate(held))
                whole = s + int(np.searchsorted(keys[s:e], keys[e - 1]))
                yield from _whole(keys[s:whole], fps[s:whole], split_over, settle, out)
                key, held, rows, hot, s = keys[e - 1], [], 0, False, whole
            if hot:
                yield out(keys[s:e], fps[s:e], True)
                continue
            held.append(fps[s:e])
            rows += e - s
            if split_over is not None and rows > split_over:
                group = np.unique(np.concatenate(held))
                held, rows = [group], len(group)
                if hot := rows > split_over:
                    yield out(np.full(rows, key), group, True)
                    held = []
    if held and not hot:
        yield settle(np.full(rows, key), np.concatenate(held))


def _whole(keys: np.ndarray, fps: np.ndarray, split_over: int | None, settle, out) -> Iterator[pa.RecordBatch]:
    """Whole keys of one batch, the hot ones apart."""
    if not len(keys):
        return
    known, counts = np.unique(keys, return_counts=True)
    large = [k for k, n in zip(known, counts) if split_over is not None and n > split_over and len(np.unique(fps[keys == k])) > split_over] if split_over is not None and counts.max() > split_over else []
    for k in large:
        group = np.unique(fps[keys == k])
        yield out(np.full(len(group), k), group, True)
    rest = ~np.isin(keys, large)
    if rest.any():
        yield settle(keys[rest], fps[rest])


def _meet(rows: DataFrame, split_over: int | None) -> DataFrame:
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp").mapInArrow(lambda it: _verify(it, split_over), "a long, b long, hot boolean")


def links(fps: DataFrame, hot_variant: int = HOT_VARIANT) -> DataFrame:
    """(a, b) over the distinct longs in column fp: links that join all fingerprints within RADIUS bits, each key's as stars."""
    masks = _masks(0, 64, BLOCKS)
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * len(masks) // TASK_VARIANTS))
    spread = fps.repartition(tasks)  # a few bytes a row in, many rows out: by their sizes alone there would be too few tasks
    met = materialize(_meet(spread.select(_variants(F.col("fp"), masks).alias("key"), "fp"), hot_variant), "simhash-met")
    found = met.where(~F.col("hot")).select("a", "b")
    hot = met.where("hot").select(F.col("a").alias("hot_key"), F.col("b").alias("fp"))
    if hot.isEmpty():
        return found.distinct()
    finer = []
    for tag, (lo, hi) in enumerate(BLOCKS):  # rows of a key that has this block masked may differ inside it alone, but for a bit or two
        third = (hi - lo) // 3
        masked = F.col("hot_key").bitwiseAND(F.lit(_signed(_bits(lo, hi)))) == F.lit(_signed(_salt(tag, lo, hi)))
        masks = _masks(lo, hi, ((lo, lo + third), (lo + third, lo + 2 * third), (lo + 2 * third, hi)))
        finer.append(hot.where(masked).select("hot_key", "fp", _variants(F.col("fp"), masks).alias("v")).select(F.xxhash64("hot_key", F.lit(lo), "v").alias("key"), "fp"))
    again = finer[0].unionByName(finer[1]).unionByName(finer[2])
    return found.unionByName(_meet(again, None).select("a", "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that it is connected to.

    Alternating large-star and small-star rounds, each written to the shared folder, until nothing changes.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    seen = mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        was, seen = seen, mark(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(docs: DataFrame, doc_id: str, text: str, hot_variant: int) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (least doc_id reachable over links), root (least fp)."""
    prints = materialize(own_columns(docs, doc_id=doc_id, text=text).select("doc_id", simhash(F.col("text")).alias("fp")), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(classes.select("fp"), hot_variant)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(members, "fp", "left").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_variant: int = HOT_VARIANT) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (least doc_id reachable over links)."""
    return _rooted(docs, doc_id, text, hot_variant).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the near copies: of each component the document with the least id stays, one row of it.

    Rows without an id cannot be named by one: they all stay.
    """
    found = _rooted(docs, doc_id, text, HOT_VARIANT).where("doc_id = component_id")
    own, keep, of = (unused(docs, name) for name in ("_fp", "_keep", "_kept_fp"))
    kept = found.groupBy("root", "doc_id").agg(F.min("fp").alias(of)).select(F.col("doc_id").alias(keep), of)
    marked = docs.withColumn(own, simhash(F.col(f"`{text}`")))
    named = marked.join(kept, (F.col(f"`{doc_id}`") == F.col(keep)) & (F.col(own) == F.col(of)), "left_semi").dropDuplicates([doc_id, own]).drop(own)
    return named.unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
