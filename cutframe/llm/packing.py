"""Best-fit packing of documents into training windows, with conflicts.

Documents are cut into pieces of at most `capacity` units. A bin holds pieces up to its capacity, and no two of
one source or of one duplicate cluster. Bins are ordered by residual and carry bitmaps of the sources and
clusters they hold. A piece, longest first, looks up the successor of its length among the residuals
and goes on upward until the tightest compatible bin is found; if there is none, it opens one.

Pieces are dealt by hash into shards of about `shard_pieces`; each shard is packed on its own, so hot sources and
clusters spread over all shards, as do rows without an id. A task holds a shard: lengths and ids, and texts only if the
caller has them travel with their pieces (a shard's are bounded: pieces times capacity).

Defined results: null or negative lengths count as 0, and pieces of length 0 are packed like others; null
sources and clusters conflict with nothing; repeated rows are packed as often as they come, ties go by
id and piece; an empty table gives no bins; extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own_columns

CAPACITY = 2048
SHARD_PIECES = 8192


class Bins:
    """Residual-ordered bins with source and cluster bitmaps."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.residuals: list[int] = []  # ascending, each once
        self.level: dict[int, list[list[int]]] = {}  # residual -> bins [id, sources, clusters], by id
        self.common: dict[int, tuple[int, int]] = {}  # residual -> bits that all its bins have: such a level has no place for them

    def _note(self, residual: int) -> None:
        sources = clusters = -1
        for _, s, c in self.level[residual]:
            sources &= s
            clusters &= c
        self.common[residual] = (sources, clusters)

    def _take(self, size: int, source: int, cluster: int) -> list[int] | None:
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[i]
            if self.common[residual][0] & source or self.common[residual][1] & cluster:
                continue
            for n, found in enumerate(self.level[residual]):
                if not (found[1] & source or found[2] & cluster):
                    del self.level[residual][n]
                    if self.level[residual]:
                        self._note(residual)
                    else:
                        del self.residuals[i], self.level[residual], self.common[residual]
                    return [*found, residual]
        return None

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of the tightest compatible bin for a piece; source and cluster are bits, 0 for none."""
        number, sources, clusters, residual = self._take(size, source, cluster) or [self.made, 0, 0, self.capacity]
        self.made += number == self.made
        left = residual - size
        if left not in self.level:
            insort(self.residuals, left)
            self.level[left] = []
            self.common[left] = (-1, -1)
        insort(self.level[left], [number, sources | source, clusters | cluster])
        s, c = self.common[left]
        self.common[left] = (s & (sources | source), c & (clusters | cluster))
        return number, self.capacity - residual


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every piece, in the order given (longest first). Ids met once need no bit."""

    def bits(values: list) -> list[int]:
        often = {v: 1 << n for n, v in enumerate(v for v, c in Counter(values).items() if c > 1 and v is not None)}
        return [often.get(v, 0) for v in values]

    bins, out, at = Bins(capacity), [], []
    for size, source, cluster in zip(sizes, bits(sources), bits(clusters)):
        number, offset = bins.place(size, source, cluster)
        out.append(number)
        at.append(offset)
    return out, at


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, source, cluster, n_units) cut into pieces of at most `capacity` units: piece, start, size."""
    size = F.greatest(F.coalesce(F.col("n_units").cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(size / capacity) - 1, F.lit(0)).cast("int")
    cut = docs.select("doc_id", "source", "cluster", size.alias("n_units"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n_units") - start, F.lit(capacity)).alias("size"), "source", "cluster")


def _dealt(cut: DataFrame, shard_pieces: int):
    shards = max(1, -(-cut.count() // shard_pieces))
    return cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "size", "source", "cluster"), F.lit(shards))).groupBy("shard")


def _packed(rows: pa.Table, capacity: int) -> pa.Table:
    """A shard's pieces, longest first, with bin_id and bin_offset."""
    rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
    numbers, offsets = pack_shard(rows["size"].to_pylist(), rows["source"].to_pylist(), rows["cluster"].to_pylist(), capacity)
    bins = pc.add(pc.multiply(rows["shard"], pa.scalar(1 << 32, pa.int64())), pa.array(numbers, pa.int64()))
    return rows.drop_columns(["shard"]).append_column("bin_id", bins).append_column("bin_offset", pa.array(offsets, pa.int64()))


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces (doc_id, piece, size, source, cluster, and any others) with bin_id and bin_offset."""
    schema = T.StructType([*cut.schema, T.StructField("bin_id", T.LongType()), T.StructField("bin_offset", T.LongType())])
    return _dealt(cut, shard_pieces).applyInArrow(lambda rows: _packed(rows, capacity), schema)


def pack_windows(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per bin of pieces that carry their texts: bin_id, size, doc_ids, and its pieces in order. Texts are shuffled once."""
    names = ("doc_id", "piece", "start", "size", "bin_offset", "text")
    kinds = {f.name: f for f in [*cut.schema, T.StructField("bin_offset", T.LongType())]}
    whole = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("doc_ids", T.ArrayType(kinds["doc_id"].dataType)), T.StructField("pieces", T.ArrayType(T.StructType([kinds[n] for n in names])))])

    def one(rows: pa.Table) -> pa.Table:
        rows = _packed(rows, capacity)
        rows = rows.append_column("_at", pa.array(range(len(rows)), pa.int64())).sort_by([("bin_id", "ascending"), ("bin_offset", "ascending"), ("_at", "ascending")]).combine_chunks()
        bins = rows["bin_id"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(bins)) + 1, len(bins)]
        columns = [rows[n].combine_chunks() if n != "text" else rows[n].cast(pa.string()).combine_chunks() for n in names]
        listed = lambda values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
        return pa.table({"bin_id": bins[cuts[:-1]], "size": np.add.reduceat(rows["size"].to_numpy(), cuts[:-1]), "doc_ids": listed(columns[0]), "pieces": listed(pa.StructArray.from_arrays(columns, names))})

    return _dealt(cut, shard_pieces).applyInArrow(one, whole)


def pack(docs: DataFrame, units: str, doc_id: str = "doc_id", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, size (in units), source, cluster, bin_id, bin_offset."""
    own = own_columns(docs, doc_id=doc_id, n_units=units, source=source, cluster=cluster).withColumns({c: F.col(c).cast("string") for c in ("source", "cluster")})
    return pack_pieces(pieces(own, capacity), capacity, shard_pieces)


def word_count(text: Column) -> Column:
    """Units of the corpus queries: words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def content_cluster(text: Column) -> Column:
    """Duplicate cluster of a text, exact copies only: hash of it without case and white space at its ends; null for null texts."""
    return F.when(text.isNotNull(), F.xxhash64(F.lower(F.trim(text))))


def bin_texts(docs: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per bin: bin_id, doc_ids and the packed text (words of the pieces, in order of their offsets)."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    cut = packed.join(own_columns(docs, doc_id=doc_id, text=text).dropDuplicates(["doc_id"]), "doc_id", "left")
    piece = F.array_join(F.slice(words, F.col("start").cast("int") + 1, F.col("size").cast("int")), " ")
    rows = cut.select("bin_id", F.struct("bin_offset", "doc_id", "piece", piece.alias("text")).alias("p"))
    return rows.groupBy("bin_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("bin_id", F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("text"))
