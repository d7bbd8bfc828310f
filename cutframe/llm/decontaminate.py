"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window is
`WINDOW` consecutive words of a benchmark item (an item of fewer words is one window of its own).

A document is scanned at aligned probes: any window of w words covers a whole probe of (w + 1) // 2
words that starts at a multiple of that length, so looking up one probe per (w + 1) // 2 words finds every
occurrence. Probes go to a broadcast hash set of the items' own probes. Around a hit, the windows that
cover the probe are verified as exact strings against the broadcast windows.

The benchmark is broadcast in blocks of about `MAX_WINDOWS` windows or `MAX_BYTES` at most, so that what is broadcast has a
bound whatever the benchmark's size; one scan of the documents serves one block.

Defined results: null and empty texts have no words and no hits; items without words match nothing;
repeated rows are each returned; ties do not matter; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, own_columns, unused

WINDOW = 13
#: Most windows that one broadcast holds, and bytes of their words: texts without separators make long words.
MAX_WINDOWS, MAX_BYTES = 1_000_000, 100_000_000
#: Fixed values of the rule: word characters, and the share of hit words from which a document counts as contaminated.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARE = 20


def words_of(text: Column) -> Column:
    """Words as they stand (cases kept): lower-casing never moves a word's borders."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _lowered(words: Column) -> Column:
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def _probe_hash(words: Column) -> Column:
    return F.xxhash64(F.lower(F.array_join(words, " ")))  # coarser than A-Z: extra hits fail the exact check


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, gram): every window of every item, distinct."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    return items.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: _lowered(F.slice("w", i, size)))).alias("gram")).distinct()


def _probe_keys(windows: DataFrame) -> DataFrame:
    """(size, probe): hashes of all runs of (size + 1) // 2 words inside the windows, distinct."""
    k = F.floor((F.col("size") + 1) / 2).cast("int")
    parts = windows.select("size", F.split("gram", " ").alias("g"), k.alias("k"))
    return parts.select("size", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: _probe_hash(F.slice("g", i, F.col("k"))))).alias("probe")).distinct()


def _document_probes(sizes: list[int]) -> Column:
    """Per document: (size, at, probe) at every multiple of (size + 1) // 2 words, and first one row without a probe."""
    none = F.struct(F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("probe"))

    def probes(size: int) -> Column:
        k = (size + 1) // 2
        last = F.floor(F.size("w") / k).cast("int") - 1
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(size).alias("size"), (i * k).alias("at"), _probe_hash(F.slice("w", i * k + 1, k)).alias("probe")))
        return F.when(F.size("w") >= size, found).otherwise(F.array().cast("array<struct<size:int,at:int,probe:bigint>>"))

    parts = [F.array(none), *map(probes, sizes)]
    return F.concat(*parts)


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (doc_id, key, n_words, first, at, size, item_id): one with first = 1 for each document row, one for each occurrence of an item's window."""
    windows = F.broadcast(windows)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW values
    scanned = docs.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("w"))
    probed = scanned.select("doc_id", "key", F.size("w").alias("n_words"), "w", F.explode(_document_probes(sizes)).alias("p")).select("doc_id", "key", "n_words", "w", "p.*")
    keys = F.broadcast(_probe_keys(windows).withColumn("known", F.lit(True)))
    met = probed.join(keys, ["size", "probe"], "left").where("size IS NULL OR known")
    k = F.floor((F.col("size") + 1) / 2).cast("int")
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") + k - F.col("size")), F.least(F.col("at"), F.col("n_words") - F.col("size")))
    # a window of w words covers one or two whole probes; keep it at the first of them
    own = F.filter(starts, lambda s: F.col("at") - s < k)
    placed = F.when(F.col("size").isNull(), F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("gram")))).otherwise(F.transform(own, lambda s: F.struct(s.alias("at"), _lowered(F.slice("w", s + 1, F.col("size"))).alias("gram"))))
    spread = met.select("doc_id", "key", "n_words", "size", F.explode(placed).alias("x")).select("doc_id", "key", "n_words", "size", "x.*")
    return spread.join(windows, ["size", "gram"], "left").where("at < 0 OR item_id IS NOT NULL").select("doc_id", "key", "n_words", (F.col("at") < 0).cast("int").alias("first"), "at", "size", "item_id")


def _covered(spans: Column) -> Column:
    """Words covered by an array of (at, size), each word once."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda acc, s: F.struct(F.greatest(acc["to"], s["at"] + s["size"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["to"], s["at"]))).alias("n")), lambda acc: acc["n"])


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit word ranges: at, size)."""
    docs = own_columns(documents, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    items = own_columns(benchmark, item_id=item_id, text=item_text)
    windows = item_windows(items, window)
    held = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length("gram"))).first()
    blocks = max(1, -(-held[0] // max_windows), -(-(held[1] or 0) // max_bytes))
    deal = F.pmod(F.xxhash64("gram"), F.lit(blocks))
    found = None
    for block in range(blocks):
        part = _hits(docs, windows.where(deal == block) if blocks > 1 else windows)
        found = part if found is None else found.unionByName(part.where("first = 0"))
    by_doc = found.groupBy("doc_id", "key", "n_words").agg(
        F.sum("first").alias("copies"),
        F.collect_set(F.when(F.col("first") == 0, F.struct("at", "size"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    out = by_doc.select("doc_id", F.col("n_words").cast("long").alias("n_words"), _covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.array_sort("spans").alias("spans"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"), "key")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).drop("_copy")


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str = "documents") -> DataFrame:
    """`documents` without what the benchmark contaminates.

    mode "documents": contaminated documents go. mode "spans": all documents stay and hit words are cut out of them, together with what
    follows each up to the next word. Documents below the share lose nothing in "documents" mode.
    """
    verdicts = contamination(documents, benchmark, doc_id, text)
    own, mark, cuts = (unused(documents, name) for name in ("_id", "_key", "_spans"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(own)) & (F.xxhash64(f"`{text}`") == F.col(mark))
    if mode == "documents":
        bad = verdicts.where("contaminated").select(F.col("doc_id").alias(own), F.col("key").alias(mark)).distinct()
        return documents.join(bad, same, "left_anti")
    if mode != "spans":
        raise ValueError(f"unknown mode: {mode}")
    hit = verdicts.where("n_hit > 0").select(F.col("doc_id").alias(own), F.col("key").alias(mark), F.col("spans").alias(cuts)).dropDuplicates([own, mark])
    body = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(body, F.lit(WORD + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(body, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    bare = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.flatten(F.transform(cuts, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    cut = F.concat(lead, F.array_join(F.transform(bare, lambda i: F.get(pieces, i)), ""))
    joined = documents.join(hit, same, "left")
    return joined.withColumn(text, F.when(F.col(cuts).isNotNull(), cut).otherwise(body)).drop(own, mark, cuts)
