"""Ranked lexical search over bit-sliced Bloom signatures: upper bounds from document-row bitmaps, exact scores for what they cannot exclude.

The index deals documents into blocks of like size. A block is a matrix of bits: a row (slice) for each position of the signature, a
column for each document. A document sets the positions of (term, level) for every level up to the term's frequency in it, so a query
reads from the AND of a term's slices which documents may hold it, and how often at most. Weighted sums of these slices are upper bounds of scores, since
bits of other terms only add to them. Exact document frequencies and sizes are counted in the same pass.

A search takes the items in blocks of at most about `MAX_TERMS` terms, against all documents' blocks. `POOL` times as many documents as wanted, those with the highest bounds, are
scored exactly; their k-th score excludes all documents whose bound is below it (or equal, with a greater id). All others are scored exactly from their texts.

Defined results: null and empty texts have no terms and are in no ranking; items without known terms have no rows; equal scores go by ascending id, null
ids first; repeated rows are ranked one by one; items of one id are ranked one by one; extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, own_columns, shared_dir

TOP = 50
#: Documents of the highest bounds that are scored first, as a multiple of those wanted: with 1, some high bounds of low scores set the floor.
POOL = 4
#: Bits of a signature for each (term, level) that it may hold, positions of one, and bits of a block.
BITS, HASHES, BLOCK_BITS = 12, 4, 1 << 23
#: Documents of a block: a multiple of 8.
BLOCK_ROWS = 1024
#: Frequencies that signatures tell apart; above the last one the document's size is the bound.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64)
#: Terms that one search sends to the tasks (a single item is never cut), and terms that a task counts before it passes them on.
MAX_TERMS, MAX_COUNTED = 20_000, 200_000
#: Pairs of an item and a document that are broadcast: some 40 bytes each.
MAX_SENT = 1_000_000
#: What a term is, and the constants of a score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LENGTH, BASE, SHARE = 1_000_000_000, 20, 100, 50
TERM_BYTES = re.compile(TERM.encode("latin-1"))

INDEXED = pa.schema([("kind", pa.string()), ("width", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("slices", pa.binary()), ("term", pa.string()), ("docs", pa.int64()), ("terms", pa.int64())])
INDEXED_DDL = "kind string, width long, doc_ids array<long>, marks array<long>, sizes array<long>, slices binary, term string, docs long, terms long"
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "item long, doc_id long, mark long, score long"
#: Stands for a null id where ids are compared.
NO_ID = np.iinfo(np.int64).min


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text. Bytes of other letters than A-Z are above 0x7F, so they are never changed or cut."""
    return TERM_BYTES.findall(text.lower())


def positions(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """(len(hashes), HASHES) positions of (term, level) in signatures of `width` bits."""
    with np.errstate(over="ignore"):
        x = hashes ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        first, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        return ((first[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(width)).astype(np.int64)


def block_slices(docs: list[tuple[np.ndarray, np.ndarray]], width: int) -> bytes:
    """Slices of a block, a bit for each document: (hashes, frequencies) of its terms in, `width` rows of packed bits out."""
    row = -(-len(docs) // 8)
    bits = np.zeros(width * row, np.uint8)
    hashes, counts = np.concatenate([h for h, _ in docs]), np.concatenate([c for _, c in docs])
    at = np.repeat(np.arange(len(docs)), [len(h) for h, _ in docs])
    for level in LEVELS:
        here = counts >= level
        if not here.any():
            break
        where = positions(hashes[here], level, width) * row + (at[here] >> 3)[:, None]
        np.bitwise_or.at(bits, where.ravel(), np.repeat((1 << (at[here] & 7)).astype(np.uint8), HASHES))
    return bits.tobytes()


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, term counts and totals of documents (doc_id, mark, text as bytes)."""
    open_blocks: dict[int, list] = defaultdict(list)
    df: Counter = Counter()
    held = words = 0

    def block(width: int) -> pa.RecordBatch:
        docs = open_blocks.pop(width)
        return _rows(INDEXED, kind=["block"], width=[width], doc_ids=[[d[0] for d in docs]], marks=[[d[1] for d in docs]], sizes=[[d[2] for d in docs]], slices=[block_slices([d[3:] for d in docs], width)])

    def counted() -> pa.RecordBatch:
        out = _rows(INDEXED, kind=["term"] * len(df), term=[t.decode() for t in df], docs=list(df.values()))
        df.clear()
        return out

    for batch in batches:
        for doc_id, mark, text in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"]):
            counts = Counter(terms_of(text.as_py()))
            if not counts:
                continue
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            keys = int(sum((tf >= level).sum() for level in LEVELS))
            width = BITS * (1 << max(4, math.ceil(math.log2(keys))))
            held, words = held + 1, words + int(tf.sum())
            df.update(counts.keys())
            open_blocks[width].append((doc_id, mark, int(tf.sum()), np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)), tf))
            if len(open_blocks[width]) >= min(BLOCK_ROWS, max(8, BLOCK_BITS // width // 8 * 8)):
                yield block(width)
            if len(df) > MAX_COUNTED:
                yield counted()
    for width in list(open_blocks):
        yield block(width)
    if df:
        yield counted()
    if held:
        yield _rows(INDEXED, kind=["total"], docs=[held], terms=[words])


@dataclass(frozen=True)
class Query:
    """A block of items as arrays: distinct terms with weights, and each item's places among them."""

    terms: list[bytes]
    weights: np.ndarray
    items: dict[int, np.ndarray]
    docs: int
    words: int

    def length(self, sizes):
        """What a document's size adds to the denominator of a score."""
        return BASE - SHARE + SHARE * sizes * self.docs // self.words

    def part(self, tf, m):
        return SCALE * tf // (1000 * tf + LENGTH * m)


def block_bounds(q: Query, hashes: np.ndarray, places: dict, width: int, sizes: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds of all documents of a block, item by item."""
    n = len(sizes)
    bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
    seen = np.zeros((len(hashes), n), np.uint8)  # levels that each document may reach in each term
    rows, present = np.arange(len(hashes)), None
    for j, level in enumerate(LEVELS):
        at = places.setdefault((width, j), positions(hashes, level, width))[rows]
        here = np.bitwise_and.reduce(bits[at], axis=1)
        here = here if present is None else here & present
        some = here.any(axis=1)
        rows, present = rows[some], here[some]
        if not len(rows):
            break
        seen[rows] += np.unpackbits(present, axis=1, bitorder="little")[:, :n]
    most = [np.minimum(sizes, nxt - 1) for nxt in LEVELS[1:]] + [sizes]
    table = np.stack([np.zeros(n, np.int64), *(q.part(tf, q.length(sizes)) for tf in most)])
    column = np.arange(n)
    for item, own in q.items.items():
        yield item, q.weights[own] @ table[seen[own], column]


def _ids(values: list) -> np.ndarray:
    return np.array([NO_ID if v is None else v for v in values], np.int64)


def highest(q: Query, k: int):
    """Task: of its blocks, the k documents with the highest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = np.array([xxhash.xxh64_intdigest(t) for t in q.terms], np.uint64), {}
        best = {item: tuple(np.empty(0, np.int64) for _ in range(3)) for item in q.items}  # bounds, ids, marks
        for batch in batches:
            for b in batch.to_pylist():
                ids, marks = _ids(b["doc_ids"]), np.array(b["marks"], np.int64)
                for item, bound in block_bounds(q, hashes, places, b["width"], np.array(b["sizes"], np.int64), b["slices"]):
                    had = best[item]
                    worst = had[0][-1] if len(had[0]) >= k else 1
                    take = np.flatnonzero(bound >= max(worst, 1))
                    if len(take):
                        joined = [np.concatenate(x) for x in zip(had, (bound[take], ids[take], marks[take]))]
                        order = np.lexsort((joined[1], -joined[0]))[:k]
                        best[item] = tuple(x[order] for x in joined)
        for item, (bound, ids, marks) in best.items():
            if len(bound):
                yield _rows(FOUND, item=[item] * len(bound), doc_id=[None if i == NO_ID else i for i in ids.tolist()], mark=marks, score=bound)

    return run


def not_excluded(q: Query, floors: dict[int, tuple[int, int]]):
    """Task: documents whose bound is above the item's floor (score, id), or equal with an id that is no greater."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places = np.array([xxhash.xxh64_intdigest(t) for t in q.terms], np.uint64), {}
        for batch in batches:
            for b in batch.to_pylist():
                ids, marks = _ids(b["doc_ids"]), np.array(b["marks"], np.int64)
                for item, bound in block_bounds(q, hashes, places, b["width"], np.array(b["sizes"], np.int64), b["slices"]):
                    score, last = floors.get(item, (0, NO_ID))
                    take = np.flatnonzero((bound > score) | ((bound == score) & (bound > 0) & (ids <= last)))
                    if len(take):
                        yield _rows(FOUND, item=[item] * len(take), doc_id=[None if i == NO_ID else i for i in ids[take].tolist()], mark=marks[take], score=bound[take])

    return run


def exact(q: Query):
    """Task: scores of documents (doc_id, mark, text as bytes, items), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(q.terms)}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, mark, text, items in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], batch["items"].to_pylist()):
                words = terms_of(text.as_py())
                m = q.length(len(words))
                parts = {number[t]: int(q.weights[number[t]]) * q.part(tf, m) for t, tf in Counter(words).items() if t in number}
                out.extend((item, doc_id, mark, sum(parts.get(i, 0) for i in q.items[item].tolist())) for item in items)
            yield _rows(FOUND, **dict(zip(FOUND.names, map(list, zip(*out))))) if out else _rows(FOUND, item=[])

    return run


def top_rows(found: DataFrame, k: int) -> DataFrame:
    """The k highest rows of each item with their rank, ties by id; first in 64 parts of an item, so that no item's rows all meet in one task."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("mark")]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order))).where(F.col("rank") <= k).drop("_part", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _documents(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = own_columns(documents, doc_id=doc_id, text=text)
    return docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))


@dataclass(frozen=True)
class Index:
    """Stored blocks, term counts and totals of a table of documents, and the table itself, from which texts are read again."""

    stored: DataFrame
    documents: DataFrame

    def _part(self, kind: str) -> DataFrame:
        return self.stored.where(F.col("kind") == kind)

    def blocks(self) -> DataFrame:
        return self._part("block").select("width", "doc_ids", "marks", "sizes", "slices")

    def totals(self) -> tuple[int, int]:
        """Documents with terms, and all their terms."""
        row = self._part("total").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        return row[0], row[1]

    def weighted(self, items: DataFrame) -> DataFrame:
        """`items` (item, term) with the weight of each term that the documents hold. Counts are summed for the items' terms alone."""
        n, _ = self.totals()
        known = self._part("term").select("term", "docs").join(items.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df"))
        return items.join(known, "term").withColumn("weight", F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long"))

    def search(self, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = TOP, max_terms: int = MAX_TERMS) -> DataFrame:
        """(item_id, rank, doc_id, score): the k highest documents of every item with a score above 0."""
        queries = materialize(own_columns(items, item_id=item_id, text=text).withColumn("item", F.monotonically_increasing_id()), "search-items")
        terms = queries.select("item", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), ascii_lower))).alias("term"))
        weighted = materialize(self.weighted(materialize(terms, "search-terms")), "search-weights")
        blocks = max(1, -(-weighted.count() // max_terms))
        ranked = None
        for number in range(blocks):
            part = self._search_block(weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number), k)
            ranked = part if ranked is None else ranked.unionByName(part)
        return ranked.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

    def _search_block(self, weighted: DataFrame, k: int) -> DataFrame:
        n, words = self.totals()
        number: dict[bytes, int] = {}
        weights, own = [], defaultdict(list)
        for r in weighted.select("item", "term", "weight").collect():  # about max_terms rows
            at = number.setdefault(r["term"].encode(), len(number))
            if at == len(weights):
                weights.append(r["weight"])
            own[r["item"]].append(at)
        q = Query(list(number), np.array(weights, np.int64), {i: np.array(p) for i, p in own.items()}, n, words)
        likely = materialize(self.blocks().mapInArrow(highest(q, POOL * k), FOUND_DDL), "search-likely")
        scored = top_rows(self._scored(top_rows(likely, POOL * k), q), k).where((F.col("rank") == k) & (F.col("score") > 0))
        floors = {r["item"]: (r["score"], NO_ID if r["doc_id"] is None else r["doc_id"]) for r in scored.collect()}  # a row an item of the block
        left = self.blocks().mapInArrow(not_excluded(q, floors), FOUND_DDL)
        return top_rows(self._scored(left, q).where("score > 0"), k)

    def _scored(self, found: DataFrame, q: Query) -> DataFrame:
        """Exact scores of (item, doc_id, mark): the documents' texts are read again. Up to MAX_SENT pairs are sent to the texts; beyond that both sides are shuffled."""
        wanted = found.groupBy("doc_id", "mark").agg(F.collect_set("item").alias("items")).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
        stored = materialize(wanted, "search-wanted")
        if stored.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] <= MAX_SENT:
            stored = F.broadcast(stored)
        met = self.documents.join(stored, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
        return met.select("doc_id", "mark", "text", "items").mapInArrow(exact(q), FOUND_DDL)


def build(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of a table of documents, in one pass, kept in the shared folder."""
    spark = documents.sparkSession
    docs = _documents(documents, doc_id, text)
    path = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    docs.mapInArrow(index_rows, INDEXED_DDL).write.partitionBy("kind").parquet(path)
    return Index(spark.read.schema(INDEXED_DDL).parquet(path), docs)
