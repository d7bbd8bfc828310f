"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, and its tokens' byte spans are joined to the spans of its sections. A
byte-level vocabulary makes this exact: the tokens' byte lengths add up to the text's. A token that crosses a
border goes by an explicit rule: "start" gives it to the section of its first byte, "end" to that of its last, "most" to the
section that holds most of its bytes (the first of equals).

Sections are lines: a line and the break after it. Their kinds are heading, list, table and prose (blank
lines are of kind blank).

Defined results: null and empty texts have no tokens and no sections; repeated rows are each counted; extra columns
are left out. Texts of any length are encoded whole. Only white space of `LONG_SPACE` or more characters in a row, which the
split pattern cannot match, is taken out first, at the borders that the pattern makes, so the tokens stay the same. Ids of any type
keep their values, null ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import own_columns

#: Vocabulary file where neither the caller nor the session's setting names one; every executor reads it at this path.
VOCABULARY, SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.cutframe.vocabulary"
#: Fixed value: the pattern that splits text before this vocabulary's merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most")
LONG_SPACE = 10_000
KINDS = {"blank": r"^\s*$", "table": r"\|.*\|", "list": r"^\s*(?:[-*+•]|\d+[.)])\s", "heading": r"^\s*#{1,6}\s|^[^.!?|]{1,80}:?\s*$"}
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)  # the pattern's \s


def load(vocabulary: str):
    """(encoding, byte length of every token)."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(text: str, encoding) -> np.ndarray:
    tokens, at = [], 0
    for m in _LONG.finditer(text):
        end = m.end() - (m.end() < len(text))  # before other text, the last space is left to what follows
        tokens += encoding.encode_ordinary(text[at : m.start()])
        tokens += encoding._encode_single_piece(text[m.start() : end].encode())
        at = end
    return np.array(tokens + encoding.encode_ordinary(text[at:]), np.int64)


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every section by the rule, and tokens that cross out of it (counted where they start). Ends ascend and agree at last."""
    starts = np.r_[0, token_ends[:-1]].astype(np.int64)
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    own = {"start": first, "end": last}.get(rule)
    if own is None:
        own = first.copy()
        for i in np.flatnonzero(last > first):
            cuts = np.r_[starts[i], section_ends[first[i] : last[i]], token_ends[i]]
            own[i] = first[i] + int(np.argmax(np.diff(cuts)))
    return np.bincount(own, minlength=len(section_ends)), np.bincount(first[last > first], minlength=len(section_ends))


def _named(spark: SparkSession, vocabulary: str | None) -> str:
    return vocabulary or spark.conf.get(SETTING, VOCABULARY)


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: str = "start", vocabulary: str | None = None) -> DataFrame:
    """One row per section: doc_id, section, kind, char_start, n_chars, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kinds = [(k, re.compile(p)) for k, p in KINDS.items()]
    path = _named(docs.sparkSession, vocabulary)
    rest = "section int, kind string, char_start long, n_chars long, n_tokens long, n_crossing long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = load(path)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for row, body in enumerate(batch.column(1).to_pylist()):
                if not body:
                    continue
                lines = body.split("\n")
                lines = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
                chars = np.cumsum([len(x) for x in lines])
                ends = chars if body.isascii() else np.cumsum([len(x.encode()) for x in lines])
                counts, crossing = attribute(np.cumsum(sizes[encode(body, encoding)]), ends, rule)
                at += [row] * len(lines)
                for n, line in enumerate(lines):
                    kind = next((k for k, p in kinds if p.search(line)), "prose")
                    rows.append((n, kind, int(chars[n]) - len(line), len(line), int(counts[n]), int(crossing[n])))
            columns = zip(*rows) if rows else [()] * 6
            typed = (pa.int32(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, typed))], ["doc_id", "section", "kind", "char_start", "n_chars", "n_tokens", "n_crossing"])

    own = own_columns(docs, doc_id=doc_id, text=text)
    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], *T.StructType.fromDDL(rest)]))


def token_pieces(docs: DataFrame, capacity: int, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Every row of `docs` cut into pieces of at most `capacity` tokens of its one encoding: all columns, with `text` that of the piece, and piece, start, size.

    A cut inside a character moves before the tokens that share it. Null and empty texts are one piece of size 0.
    """
    path, names = _named(docs.sparkSession, vocabulary), docs.columns
    place = names.index(text)
    schema = T.StructType([*docs.schema, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = load(path)
        for batch in batches:
            at, parts, rows = [], [], []
            for row, body in enumerate(batch.column(place).to_pylist()):
                ends = np.cumsum(sizes[encode(body or "", encoding)])
                raw = (body or "").encode() if len(ends) > capacity else b""
                start = n = 0
                while len(ends) - start > capacity:
                    stop = start + capacity
                    while raw[ends[stop - 1]] & 0xC0 == 0x80:  # the next byte goes on with a character
                        stop -= 1
                    at.append(row)
                    parts.append(raw[ends[start - 1] if start else 0 : ends[stop - 1]].decode())
                    rows.append((n, start, stop - start))
                    start, n = stop, n + 1
                at.append(row)
                parts.append(raw[ends[start - 1] :].decode() if start else body)
                rows.append((n, start, len(ends) - start))
            taken = batch.take(pa.array(at, pa.int32())).columns
            taken[place] = pa.array(parts, pa.string())
            columns = zip(*rows) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64())))], [*names, "piece", "start", "size"])

    return docs.mapInArrow(run, schema)


def document_tokens(sections: DataFrame) -> DataFrame:
    """Sections to one row per document: total, and tokens by kind of section."""
    kinds = (*KINDS, "prose")
    return sections.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_sections"), F.sum("n_crossing").alias("n_crossing"), *(F.sum(F.when(F.col("kind") == k, F.col("n_tokens")).otherwise(0)).alias(f"tokens_{k}") for k in kinds))
