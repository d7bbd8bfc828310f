"""Document fingerprints: an invertible Bloom lookup sketch of a text's paragraphs.

A text's units (paragraphs, cut where they exceed `UNIT_WORDS` words) are hashed to 64-bit digests, each set
once. A sketch has three subtables of `SUB` cells; a digest falls into one cell of each, and a cell holds how many digests it
has, their XOR and the XOR of their checks. The sketches of two versions are subtracted cell by cell, which cancels what
they share; cells with a single digest are peeled, each freeing others, until the differing digests
are recovered. Where peeling gets stuck the digests are dealt into parts by further bits, each part is sketched anew, and so
the sketch is larger in all, until every part peels.

Everything is a column expression: higher-order functions over a row's own arrays, no joins and no Python.

Defined results: null texts count as empty; texts without words have an empty sketch, and two of those are alike (1.0); repeated
rows and ties are each given a result; ids are integers (others raise); extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_columns

UNIT_WORDS = 16
SUB = 8
ROUNDS = 12
LEVELS = 12
#: Digests of both sides in a part that is sketched anew: half its cells.
FEW = 12
#: Documents in one range of ids that is sorted together, and most ranges (their edges are held by the driver); beyond, ranges grow and sorts spill.
RANGE_ROWS = 1024
MAX_RANGES = 20_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's units."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:\S++[^\S\n]*+){1,%d}" % UNIT_WORDS), F.lit(0))
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(F.rtrim(u))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1)).bitwiseAND(0xFFFFFFFF)


def _bits(key: Column, at: Column, mask: int) -> Column:
    return F.call_function("shiftrightunsigned", key, at).bitwiseAND(F.lit(mask).cast("long"))


def _place(level: Column) -> Column:
    """Where a level's bits are: those of its parts in the upper 18, those of a digest's cells (which differ from level to level) in the lower 45."""
    return F.struct(((level + 8) * 2 % 18 + 46).cast("int").alias("part"), *((level % 5 * 9 + 3 * s).cast("int").alias(f"s{s}") for s in range(3)))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.alias("key"), check.alias("check"))


def _none() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def _fill(rows: Column) -> Column:
    """3 * SUB cells of rows (key, check, n, s0, s1, s2): each row is in one cell of every subtable."""

    def table(rows: Column, sub: int) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUB - 1).cast("long")), lambda j: F.aggregate(F.filter(rows, lambda r: r[f"s{sub}"] == j), _none(), lambda a, r: _cell(a["n"] + r["n"], a["key"].bitwiseXOR(r["key"]), a["check"].bitwiseXOR(r["check"]))))

    return _let(rows, lambda r: F.concat(*(table(r, s) for s in range(3))))


def _rows(keys: Column, n: int, place: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), _check(k).alias("check"), F.lit(n).alias("n"), *(_bits(k, place[f"s{s}"], SUB - 1).alias(f"s{s}") for s in range(3))))


def sketch(keys: Column, level: Column) -> Column:
    """3 * SUB cells (n, key, check) of an array of digests, placed by the bits of a level (0: as in stored fingerprints)."""
    return _fill(_rows(keys, 1, _place(level)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def _used(cells: Column) -> Column:
    return F.filter(cells, lambda c: (c["n"] != 0) | (c["key"] != 0))


def peel(cells: Column, place: Column) -> Column:
    """(cells, found) after peeling: found are the differing digests (key, n: 1 first side only, -1 second); peeled fully if no cell is left."""
    found_type = "array<struct<key:bigint,n:int>>"

    def step(acc: Column, _: Column) -> Column:
        single = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]))
        pure = F.array_distinct(F.transform(single, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"))))

        def remove(pure: Column) -> Column:
            own = F.transform(pure, lambda p: F.struct(p["key"].alias("key"), p["n"].alias("n"), _check(p["key"]).alias("check"), F.array(*((_bits(p["key"], place[f"s{s}"], SUB - 1) + s * SUB).cast("int") for s in range(3))).alias("at")))
            less = lambda own: F.transform(acc["cells"], lambda c: F.aggregate(F.filter(own, lambda p: F.array_contains(p["at"], c["i"])), c, lambda x, p: F.struct(x["i"].alias("i"), (x["n"] - p["n"]).alias("n"), x["key"].bitwiseXOR(p["key"]).alias("key"), x["check"].bitwiseXOR(p["check"]).alias("check"))))
            return F.struct(_used(_let(own, less)).alias("cells"), F.concat(acc["found"], pure).alias("found"), F.lit(True).alias("more"))

        stop = F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(False).alias("more"))
        return F.when(acc["more"], _let(pure, lambda p: F.when(F.size(p) > 0, remove(p)).otherwise(stop))).otherwise(acc)

    numbered = F.transform(cells, lambda c, i: F.struct(i.alias("i"), c["n"].alias("n"), c["key"].alias("key"), c["check"].alias("check")))
    start = F.struct(_used(numbered).alias("cells"), F.array().cast(found_type).alias("found"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def differing(a: Column, b: Column, cells_a: Column | None = None, cells_b: Column | None = None) -> Column:
    """Differing digests (key, n) of two arrays of distinct digests: subtract their sketches (given, else made here) and peel.

    Where peeling stops, the digests are dealt four ways, again and again until a part holds at most `FEW` of
    both sides, and each part gets a sketch of its own: as many cells in all as the sizes of both sides need. Parts that do not peel are dealt on.
    """
    todo_type, found_type = "array<struct<a:array<bigint>,b:array<bigint>>>", "array<struct<key:bigint,n:int>>"

    def step(acc: Column, place: Column) -> Column:
        def attempt(t: Column) -> Column:
            both = F.concat(_rows(t["a"], 1, place), _rows(t["b"], -1, place))  # one side's digests are subtracted as they come
            none = F.struct(t["a"].alias("a"), t["b"].alias("b"), F.array().cast(found_type).alias("found"), F.lit(False).alias("done"))
            tried = _let(peel(_fill(both), place), lambda p: F.struct(t["a"].alias("a"), t["b"].alias("b"), p["found"].alias("found"), (F.size(p["cells"]) == 0).alias("done")))
            return F.when(F.size(t["a"]) + F.size(t["b"]) > FEW, none).otherwise(tried)

        def parts(t: Column) -> Column:
            return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda q: F.struct(F.filter(t["a"], lambda k: _bits(k, place["part"], 3) == q).alias("a"), F.filter(t["b"], lambda k: _bits(k, place["part"], 3) == q).alias("b")))

        def settle(tried: Column) -> Column:
            done = F.flatten(F.transform(F.filter(tried, lambda t: t["done"]), lambda t: t["found"]))
            todo = F.flatten(F.transform(F.filter(tried, lambda t: ~t["done"]), parts))
            return F.struct(todo.alias("todo"), F.concat(acc["found"], done).alias("found"))

        return F.when(F.size(acc["todo"]) > 0, _let(F.transform(acc["todo"], attempt), settle)).otherwise(acc)

    none = F.array().cast(todo_type)
    whole = F.array(F.struct(a.alias("a"), b.alias("b"))).cast(todo_type)
    cells_a, cells_b = (sketch(keys, F.lit(0)) if cells is None else cells for keys, cells in ((a, cells_a), (b, cells_b)))
    first = _let(peel(subtract(cells_a, cells_b), _place(F.lit(0))), lambda p: F.when(F.size(p["cells"]) == 0, F.struct(none.alias("todo"), p["found"].alias("found"))).otherwise(F.struct(whole.alias("todo"), F.array().cast(found_type).alias("found"))))
    left = lambda acc: F.flatten(F.transform(acc["todo"], lambda t: F.concat(F.transform(F.array_except(t["a"], t["b"]), lambda k: F.struct(k.alias("key"), F.lit(1).alias("n"))), F.transform(F.array_except(t["b"], t["a"]), lambda k: F.struct(k.alias("key"), F.lit(-1).alias("n"))))))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(LEVELS - 1)), _place), first, step, lambda acc: F.concat(acc["found"], left(acc)))


def _share(total: Column, differ: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differ) / (total + differ))


def likeness(a: Column, b: Column, cells_a: Column | None = None, cells_b: Column | None = None) -> Column:
    """Share of common digests among all, from the sizes of both sides and their recovered differences."""
    return _let(F.size(differing(a, b, cells_a, cells_b)).cast("double"), lambda d: _share((F.size(a) + F.size(b)).cast("double"), d))


def encode(cells: Column) -> Column:
    """A sketch as text: count, key and check of every cell in hex."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["n"]), F.lit(":"), F.hex(c["key"]), F.lit(":"), F.hex(c["check"]))), ",")


def decode(fingerprint: Column) -> Column:
    """Cells of a sketch's text."""
    number = lambda x: F.conv(x, 16, -10).cast("long")
    return F.transform(F.split(fingerprint, ","), lambda c: _let(F.split(c, ":"), lambda p: _cell(F.conv(p[0], 16, -10).cast("int"), number(p[1]), number(p[2]))))


def fingerprint(text: Column) -> Column:
    """The sketch of a whole text, as text."""
    return encode(sketch(digests(text), F.lit(0)))


def stored_likeness(a: Column, b: Column) -> Column:
    """Likeness of two stored fingerprints, without their texts; null where they differ by more digests than their cells let peel."""

    def compare(both: Column) -> Column:
        total = F.aggregate(F.slice(both["a"], 1, SUB), F.lit(0), lambda n, c: n + c["n"]) + F.aggregate(F.slice(both["b"], 1, SUB), F.lit(0), lambda n, c: n + c["n"])
        return _let(peel(subtract(both["a"], both["b"]), _place(F.lit(0))), lambda p: F.when(F.size(p["cells"]) == 0, _share(total.cast("double"), F.size(p["found"]).cast("double"))))

    return _let(F.struct(decode(a).alias("a"), decode(b).alias("b")), compare)


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, derived: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, next_text) where next is the following document by doc_id (nulls first), after the last the first.

    Documents are dealt into ranges of ids, each sorted on its own; the first document of a range is also sent, as a
    mark at its end, to the range before. Texts are shuffled once. Columns `derived` from the text are made after that, once a
    document, and returned with those of the next one (next_*).
    """
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("with_next orders documents by integer ids")
    derived = derived or {}
    n, least, nulls = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    ranges = min(MAX_RANGES, max(1, -(-n // range_rows)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000 + 10 * ranges)).first()[0] if ranges > 1 else []
    edges = sorted({*(cuts or []), *([least] if least is not None else [0])})
    table = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(edges).bit_length()))]  # binary search for the last edge at or below the id
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s < len(edges)) & (F.get(table, F.least(at + s, F.lit(len(edges) - 1))) <= F.col("doc_id")), at + s).otherwise(at))
    placed = docs.withColumn("_range", F.coalesce(place, F.lit(0)))
    is_edge = F.get(table, F.col("_range")) == F.col("doc_id")
    is_first = F.col("doc_id").isNull() if nulls else is_edge & (F.col("_range") == 0)
    before = F.when(is_first, F.lit(len(edges) - 1)).when(is_edge & (F.col("_range") > 0), F.col("_range") - 1)
    slots = F.filter(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("mark")), F.struct(before.alias("range"), F.lit(1).alias("mark"))), lambda s: s["range"].isNotNull())
    dealt = placed.select("doc_id", "text", F.explode(slots).alias("s")).select("doc_id", "text", "s.range", "s.mark").repartition("range")
    order = Window.partitionBy("range").orderBy("mark", F.col("doc_id").asc_nulls_first(), "text")
    for name, column in derived.items():
        dealt = dealt.withColumn(name, column)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *derived)}).where("mark = 0").drop("range", "mark")


def version_fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last quarter from the next document), and how alike they are."""
    docs = own_columns(documents, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    size = F.length("text")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), size - quarter), F.col("next_text").substr(F.lit(1), quarter))
    own = {"keys": digests(F.col("text")), "cells": sketch(F.col("keys"), F.lit(0))}
    both = with_next(docs, derived=own).withColumns({"n_chars": size.cast("long"), "edited": edited}).drop("text", "next_text")
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_keys", digests(F.col("edited"))).drop("edited").withColumn("edited_cells", sketch(F.col("edited_keys"), F.lit(0)))
    near = {kind: likeness(F.col("keys"), F.col(f"{kind}_keys"), F.col("cells"), F.col(f"{kind}_cells")).alias(f"near_{kind}") for kind in ("edited", "next")}
    return both.select("doc_id", "n_chars", "edited_sha256", encode(F.col("cells")).alias("fingerprint"), encode(F.col("edited_cells")).alias("edited_fingerprint"), *near.values())
