"""URL filter by a Bloom filter cascade: exact membership in a list, without joins.

Level 1 is a Bloom filter of the listed keys. Of all other keys that the corpus holds (its complete key
universe) some pass it by chance; level 2 encodes those. Listed keys that pass level 2 by chance are encoded in
level 3, and so on until a level lets no key of the other side pass. For every key of the universe the
number of levels that it passes then tells exactly whether it is listed.

The levels are bit arrays inside the query's own expressions, each of them once. Where they would take more than `max_bits`, the
key space is dealt into parts with a cascade of their own, and the urls are judged part by part: there is no size from which
on another method takes over. A url's keys are all pairs of a host suffix (at a dot) and a path prefix (up to a slash, or the
whole path) no deeper than the deepest listed key. The list is a table; the corpus's keys are derived in one scan and stored.

Defined results: null urls and urls without :// have empty host and path and no keys; null listed keys are left out; ties
between keys of one length go to the longer host; repeated rows are judged one by one. All columns of the input stay as they are,
whatever their names, but for one that is called like the column of results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

#: Bits of one part's cascade, which is sent to every task: 8 MB.
MAX_BITS = 1 << 26
MAX_LEVELS = 64
#: Share of keys that pass a level after the first by chance: few levels, each one small beside the first.
LATER_FPP = 1 / 8
# The rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words in a host that put it, with all its pages, on the block list.
LISTED_WORDS = ("casino", "poker", "jackpot", "viagra")
#: What the text of a junk page looks like: words that end in three signs.
JUNK = r"[%*#$]{3} .*[%*#$]{3} .*[%*#$]{3} "


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, host_labels: int, path_parts: int) -> Column:
    """All keys of a url: suffixes of up to `host_labels` labels with path prefixes of up to `path_parts` slashes, and the whole path within these."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(host_labels))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(path_parts))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    whole = F.when((F.size(parts) - 1 <= path_parts) & (F.element_at(parts, -1) != ""), F.array(path)).otherwise(F.array().cast("array<string>"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.concat(prefixes, whole), lambda p: F.concat(s, p))))
    return F.when((host != "") & (F.size(parts) > 1), keys).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    salt: int
    hashes: int
    bits: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        """The bit array stands in the expression once."""
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folds to one literal
        at = F.array(*(_position(key, self.salt, i, self.bits) for i in range(self.hashes)))
        return F.forall(at, lambda at: F.get(table, F.floor(at / 64).cast("int")).bitwiseAND(_power(at)) != 0)


def _power(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def _position(key: Column, salt: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(i)), F.lit(bits).cast("long"))


def _level(keys: DataFrame, n: int, fpp: float, salt: int) -> Level:
    hashes = max(1, round(-math.log2(fpp)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    at = F.explode(F.array(*(_position(F.col("key"), salt, i, bits) for i in range(hashes))))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(_power(F.col("at"))).alias("set")).toArrow()  # at most bits / 64 words: see `parts`
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["set"].to_numpy()
    return Level(salt, hashes, bits, tuple(words.tolist()))


def _first_fpp(inside: int, outside: int) -> float:
    return min(0.5, max(1e-6, math.sqrt(0.5) * inside / max(1, outside)))


def parts(inside: int, outside: int, max_bits: int) -> int:
    """Parts of the key space so that each one's levels stay below `max_bits`; as many keys as are listed, at most, pass the first level."""
    bits = 1.2 * inside * (max(1, round(-math.log2(_first_fpp(inside, outside)))) - math.log2(LATER_FPP)) / math.log(2)
    return max(1, math.ceil(bits / max_bits))


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels for the distinct rows (key, listed) of a key universe. Listed keys outside the universe need no bits: no url of the corpus has them."""
    sides = [keys.where("listed"), keys.where("NOT listed")]
    counts = [side.count() for side in sides]
    levels: list[Level] = []
    while counts[0]:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end; the key universe holds listed keys twice")
        level = _level(sides[0], counts[0], LATER_FPP if levels else _first_fpp(*counts), len(levels) + 1)
        levels.append(level)
        passed = materialize(sides[1].where(level.passes(F.col("key"))), "url-passed")
        sides, counts = [passed, sides[0]], [passed.count(), counts[0]]
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Passing an odd number of levels in a row means listed."""
    verdict = F.lit(len(levels) % 2 == 1)
    for n in range(len(levels), 0, -1):
        verdict = F.when(levels[n - 1].passes(key), verdict).otherwise(F.lit(n % 2 == 0))
    return verdict


def rule_keys(spark, rules=RULES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(h + p) for h, p, _ in rules))).alias("key"))


def listed_hosts(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS, url: str = "url") -> DataFrame:
    """(key): every host of the corpus that holds a listed word, with all its pages."""
    host = host_of(F.col(f"`{url}`"))
    return pages.where(host.rlike("|".join(words))).select(F.concat(host, F.lit("/")).alias("key")).distinct()


def listed_junk(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(key): host and path of every page whose text is junk."""
    address = F.col(f"`{url}`")
    return pages.where(F.col(f"`{html}`").rlike(JUNK) & (host_of(address) != "") & path_of(address).startswith("/")).select(F.concat(host_of(address), path_of(address)).alias("key")).distinct()


def _depth(keys: DataFrame) -> tuple[int, int]:
    """Most host labels and path slashes of a listed key."""
    deepest = keys.agg(F.max(F.size(F.split(F.regexp_extract("key", "^[^/]*", 0), r"\."))), F.max(F.size(F.split("key", "/")) - 1)).first()
    return deepest[0] or 1, deepest[1] or 1


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, url: str = "url", rules=RULES, max_bits: int = MAX_BITS, out: str = "judged") -> DataFrame:
    """`pages` with a struct `out` of host, path, rule, listed (longest listed key, a rule's or one of `listed`), verdict. `listed` has keys host/path to block; by default listed_hosts(pages)."""
    spark, address = pages.sparkSession, F.col(f"`{url}`")
    listed = listed_hosts(pages, url=url) if listed is None else listed
    known = materialize(rule_keys(spark, rules).unionByName(listed.select("key")).where("key IS NOT NULL").distinct(), "url-list")
    labels, slashes = _depth(known)
    urls = pages.select(host_of(address).alias("host"), path_of(address).alias("path")).distinct()
    universe = urls.select(F.explode(url_keys(F.col("host"), F.col("path"), labels, slashes)).alias("key")).distinct()
    keys = materialize(universe.join(known.withColumn("listed", F.lit(True)), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "url-keys")
    inside, outside = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    n = parts(inside, outside, max_bits)
    part = lambda key: F.pmod(F.xxhash64(key, F.lit(0)), F.lit(n))
    no_hits = F.array().cast("array<string>")
    judged = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), no_hits.alias("hits"))
    address = F.col(f"row.`{url}`")
    for k in range(n):
        levels = build_cascade(keys.where(part(F.col("key")) == k) if n > 1 else keys)
        if levels:
            own = url_keys(host_of(address), path_of(address), labels, slashes)
            own = F.filter(own, lambda x: part(x) == k) if n > 1 else own
            judged = judged.withColumn("hits", F.concat("hits", F.filter(own, lambda x: is_listed(x, levels))))
        if n > 1:  # the next part's bits are another pass
            judged = materialize(judged, "url-hits")
    longest = F.transform(F.array_sort(F.transform("hits", lambda k: F.struct((-F.length(k)).alias("n"), (-F.length(F.regexp_extract(k, "^[^/]*", 0))).alias("h"), k.alias("key")))), lambda x: x["key"])
    fixed = {v: [h + p for h, p, verdict in rules if verdict == v] for v in ("block", "allow")}
    judged = judged.withColumn("hits", longest)
    rule = F.get(F.filter("hits", lambda k: k.isin(*fixed["block"], *fixed["allow"])), F.lit(0))
    verdict = lambda rule: F.when(rule.isin(*fixed["allow"]), "allow").when(rule.isNotNull() | (F.size("hits") > 0), "block").otherwise("allow")
    result = F.struct(host_of(address).alias("host"), path_of(address).alias("path"), rule.alias("rule"), F.get("hits", F.lit(0)).alias("listed"), verdict(rule).alias("verdict"))
    return judged.select(*(F.col(f"row.`{c}`") for c in pages.columns if c != out), result.alias(out))
