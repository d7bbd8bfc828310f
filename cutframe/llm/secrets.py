"""Secret scan: keyword automaton, anchored patterns only at its hits, checksums inside the hits.

One pass of an Aho-Corasick automaton over the folded text yields the places where a keyword of a
pattern stands; only there is the pattern tried, anchored. Kinds that carry a checksum are then
verified. Runs of hex digits have no keyword, so they come from one linear scan.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; rows,
also repeated ones, are judged one by one; extra columns pass through untouched.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

# Fixed values of the base kinds: their patterns, least lengths and order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
BASE_KINDS = ("assign", "access", "hex")
# Fixed values of the added kinds: prefixes of public token formats.
CRC_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT_RUN, JWT_REST = re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = (*BASE_KINDS, "crc_token", "jwt")


def crc_suffix(body: str) -> str:
    """CRC-32 of the random part, as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def valid_jwt(token: str) -> bool:
    """The header is base64url JSON that names an algorithm."""
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):
        return False


def jwts(text: str, hits) -> list[tuple[int, int]]:
    """(start, end) of valid tokens at the hits. All hits in one run of its characters share the run's end, so each run is read once."""
    out, free, run = [], 0, 0
    for start in hits:
        if start < free or not text.startswith("eyJ", start):
            continue
        if start >= run:
            run = JWT_RUN.match(text, start).end()
            rest = JWT_REST.match(text, run)
        if rest and run - start > 3:
            free = rest.end()
            if valid_jwt(text[start:free]):
                out.append((start, free))
    return out


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("crc_token", CRC_PREFIXES), ("jwt", ("eyj",))):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans(text: str | None, automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and then kind."""
    if not text:
        return []
    folded = text.encode("latin-1", "replace").lower().decode("latin-1")  # one character for each code point
    hits: dict[str, list[int]] = {}
    for end, (kind, size) in automaton.iter(folded):
        hits.setdefault(kind, []).append(end + 1 - size)
    found = [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    found += [(start, "jwt", end) for start, end in jwts(text, hits.get("jwt", ()))]
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("crc_token", CRC_TOKEN)):
        free = 0  # leftmost and non-overlapping: a match uses up its text even if it is then dropped
        for start in sorted(hits.get(kind, ())):
            if start < free or not (m := pattern.match(text, start)):
                continue
            free = m.end()
            if kind == "assign":
                good = len(m[2]) >= ASSIGN_LEAST
            elif kind == "access":
                good = len(m[0]) >= ACCESS_LEAST
            else:
                good = crc_suffix(m[1]) == m[2]
            if good:
                found.append((start, kind, m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


@F.pandas_udf(T.StringType())
def _spans_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    automaton = _automaton()
    for batch in texts:
        yield pd.Series([",".join(f"{kind}:{start}:{end}" for start, kind, end in spans(text, automaton)) for text in batch], dtype=object)


def span_list(text: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas ('' for none)."""
    return _spans_text(text)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """`docs` with an array of (kind, start, end) in column `out`."""
    spans = unused(docs, "_spans")
    parts = F.split(F.col(spans), ",")
    rows = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.split(p, ":")[0].alias("kind"), F.split(p, ":")[1].cast("int").alias("start"), F.split(p, ":")[2].cast("int").alias("end")))
    return docs.withColumn(spans, span_list(F.col(f"`{text}`"))).withColumn(out, rows).drop(spans)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret span of `text` replaced by `mask`; overlapping spans are masked once."""
    secrets = unused(docs, "_secrets")
    found = find_secrets(docs, text, secrets)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], body.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    done = F.aggregate(F.sort_array(F.transform(secrets, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), done)).drop(secrets)


def digest_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""
    scanned = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), span_list(F.col(f"`{text}`")).alias("spans"))
    base = F.filter(F.split("spans", ","), lambda p: F.split(p, ":")[0].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda p: p.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        "spans",
    )
