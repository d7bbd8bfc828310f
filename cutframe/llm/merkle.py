"""Merkle manifest of a dataset, with nested-interval labels: every node carries the interval of leaf ranks that it covers.

A row's leaf digest is SHA-256 (hex) of its fields; leaves of one group (language) in order of their ids are a tree, and the trees'
roots, in order of their groups, are the leaves of one more. Runs of `fanout` nodes become the digest of their digests, a last run of fewer too.

Ranks come from one global sort: places within the sorted partitions plus the sizes of the partitions before. Levels are
built in bands of `BAND`: the nodes of a band meet in buckets of `fanout ** BAND` neighbours (level bucket and interval start),
so a tree of any size takes one shuffle a band and no group grows with the data. A node's ancestors are attached by containment of intervals inside the
bucket, and its siblings are the nodes in what is left of the parent's interval without its own. From the top band down each bucket
takes the path of the node above it, which holds one row a bucket.

Defined results: null fields are `-` in a leaf; null groups come first, null ids before others; repeated ids keep one leaf each, by
digest; equal rows are leaves of their own with proofs of their own; an empty table has no rows and no root; texts of any length are hashed whole; columns
that are not asked for do not matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, own_columns

FANOUT, BAND = 2, 5
NODE = "array<struct<lo:bigint,hi:bigint,digest:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose ids this divides (by CRC-32) are tampered with in the query.
TAMPERED = 7


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A field inside a leaf: `-` for null, else its size in bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return digest(*map(encoded, fields))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """`leaves` (tree, leaf, ...) with rank (from 0 in its tree, by `order`, nulls first) and n, the tree's number of leaves.

    One sort of all rows; what the partitions before hold of a tree is added from their counts.
    """
    placed = materialize(leaves.orderBy("tree", *order).withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)  # the number of the sorted partition
    counts = placed.groupBy("tree", part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select(F.col("tree").alias("_tree"), "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_rows").over(whole).alias("n"))
    small = materialize(based, "merkle-parts")  # a row for each partition and tree: its size is known when the join is planned
    met = placed.withColumn("_own", part).join(small, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_own") == F.col("_part")))
    return met.withColumn("rank", F.col("_at") + F.col("_base")).drop("_at", "_own", "_tree", "_part", "_base")


def _grown(nodes: str, fanout: int) -> Column:
    """The level above the column `nodes`; none above a tree's root."""
    run = f"slice({nodes}, i * {fanout} + 1, {fanout})"
    up = f"transform(sequence(0, CAST((size({nodes}) - 1) div {fanout} AS INT)), i -> named_struct('lo', {nodes}[i * {fanout}].lo, 'hi', element_at({run}, -1).hi, 'digest', sha2(array_join({run}.digest, ''), 256)))"
    return F.expr(f"CASE WHEN size({nodes}) > 0 AND (more OR size({nodes}) > 1) THEN {up} ELSE CAST(array() AS {NODE}) END")


def _levels(blocks: DataFrame, fanout: int) -> DataFrame:
    """Blocks with columns _l0 .. _l<BAND>: the nodes of each level of the band, by interval, and `top`, the highest one."""
    out = blocks.withColumn("_l0", F.expr("transform(items, x -> named_struct('lo', x.lo, 'hi', x.hi, 'digest', x.digest))"))
    for k in range(BAND):
        out = out.withColumn(f"_l{k + 1}", _grown(f"_l{k}", fanout))
    return out.withColumn("top", F.coalesce(*(F.get(F.col(f"_l{k}"), F.lit(0)) for k in range(BAND, -1, -1))))


def _with_siblings(nodes: str, parents: str) -> str:
    """SQL for (lo, hi, before, after) of nodes under a parent: the digests of what lies in the parent's interval before and after the node's own."""
    before, after = "s.lo >= p.lo AND s.hi <= x.lo", "s.lo >= x.hi AND s.hi <= p.hi"
    joined = [f"array_join(filter({nodes}, s -> {inside}).digest, '')" for inside in (before, after)]
    under = f"transform(filter({parents}, p -> p.lo <= x.lo AND x.hi <= p.hi), p -> named_struct('lo', x.lo, 'hi', x.hi, 'before', {joined[0]}, 'after', {joined[1]}))"
    return f"flatten(transform({nodes}, x -> {under}))"


@dataclass(frozen=True)
class Forest:
    """Trees as stored tables, one a band: tree, start (its bucket's first rank), more (whether bands follow), items (lo, hi, digest, and the leaf's own columns)."""

    bands: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """(tree, root)."""
        out = None
        for band in self.bands:
            done = _levels(band.where(~F.col("more")), self.fanout).select("tree", F.col("top.digest").alias("root"))
            out = done if out is None else out.unionByName(done)
        return out

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, digest): every node with its label; hi is exclusive."""
        out = None
        for b, band in enumerate(self.bands):
            grown = _levels(band, self.fanout)
            for k in range(0 if b else -1, BAND):
                # explode_outer: a filter on the size of the array would be pushed down through all levels, each written out once for every use
                part = grown.select("tree", F.lit(b * BAND + k + 1).alias("level"), F.explode_outer(f"_l{k + 1}").alias("x")).where("x IS NOT NULL").select("tree", "level", "x.*")
                out = part if out is None else out.unionByName(part)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """Every leaf: tree, lo, its own columns, path (before, after: siblings' digests from the leaf up), and the columns of `above`.

        `above` has a row for each tree: tree, path (what follows the tree's root) and any other columns.
        """
        extra = [c for c in above.columns if c not in ("tree", "path")]
        ends = above.select(F.col("tree").alias("_tree"), F.col("path").alias("_path"), *extra)
        below = None  # the items of the band above, with their paths
        for band in reversed(self.bands):
            last = band.where(~F.col("more")).join(ends, F.col("tree").eqNullSafe(F.col("_tree")))
            met = last.drop("_tree")
            if below is not None:
                upper = below.select(F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("path").alias("_path"), *extra)
                met = met.unionByName(band.where("more").join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("start") == F.col("_lo"))).drop("_tree", "_lo"))
            grown = _levels(met, self.fanout)
            labelled = grown.withColumn("_nodes", F.concat(*(F.expr(_with_siblings(f"_l{k}", f"_l{k + 1}")) for k in range(BAND))))
            each = labelled.select("tree", "_nodes", "_path", *extra, F.explode("items").alias("x"))
            own = F.expr("transform(filter(_nodes, y -> y.lo <= x.lo AND x.hi <= y.hi), y -> named_struct('before', y.before, 'after', y.after))")
            below = each.select("tree", "x.*", F.concat(own, "_path").alias("path"), *extra)
        return below


def forest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Forest:
    """Trees over `leaves` (tree, leaf and other columns, which stay with the leaf)."""
    own = [c for c in leaves.columns if c not in ("tree", "leaf")]
    rows = ranked(leaves, order)
    items = rows.select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), *own)
    bands: list[DataFrame] = []
    span = fanout**BAND
    while True:
        names = ["lo", "hi", "digest", *(own if not bands else [])]
        width = span ** (len(bands) + 1)
        start = (F.floor(F.col("lo") / width) * width) if width < 1 << 50 else F.expr(f"lo div {width} * {width}")
        grouped = items.groupBy("tree", "n", start.cast("long").alias("start")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("items"))
        bands.append(materialize(grouped.withColumn("more", F.col("n") > width), "merkle-band"))
        if not bands[-1].where("more").limit(1).count():
            return Forest(bands, fanout)
        items = _levels(bands[-1].where("more"), fanout).select("tree", "n", "top.lo", "top.hi", "top.digest")


@dataclass(frozen=True)
class Manifest:
    groups: Forest
    top: Forest

    def root(self) -> str | None:
        row = self.top.roots().first()
        return row["root"] if row else None

    def proofs(self) -> DataFrame:
        """Every leaf's columns with its path to the root, subroot and root."""
        ends = self.top.roots().select("tree", "root", F.array().cast("array<struct<before:string,after:string>>").alias("path"))
        tops = self.top.paths(ends).select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
        return self.groups.paths(tops)


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Manifest:
    """The manifest of `leaves` (tree, leaf, ...): a tree for each value of `tree`, and one over their roots."""
    groups = forest(leaves, order, fanout)
    return Manifest(groups, forest(groups.roots().select(F.lit("").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("group")), ["group"], fanout))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def document_leaves(documents: DataFrame, group: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(tree, doc_id, leaf, tampered) of rows with the columns of documents; tampered is the leaf with one character more claimed, for the rows that are tampered with."""
    docs = own_columns(documents, **{f: f for f in FIELDS} | {"doc_id": doc_id, "lang": group})
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    claimed = leaf_digest(*(F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS))
    return docs.select(F.col("lang").alias("tree"), "doc_id", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), F.when(hit & F.col("n_chars").isNotNull(), claimed).alias("tampered"))


def verified_documents(documents: DataFrame) -> DataFrame:
    """One row per document: leaf, subroot, root, the digest of its proof, the root from the (tampered) leaf, and whether they agree."""
    rows = manifest(materialize(document_leaves(documents), "merkle-leaves"), ["doc_id", "leaf"]).proofs()
    checked = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))

