"""Merkle manifest, chat formatting and ranked search: each against a plain version, on odd inputs too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cutframe.llm import chat, lexical, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, more=0):
    n = row["n_chars"] + more if row["n_chars"] is not None else None
    values = [row["doc_id"], row["source"], row["lang"], n, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_path(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def plain_proofs(rows, fanout=2):
    trees = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r))):
        trees[r["lang"]].append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    levels = {t: plain_levels([plain_leaf(r) for r in trees[t]], fanout) for t in order}
    top = plain_levels([levels[t][-1][0] for t in order], fanout)
    out = []
    for t in order:
        for at, r in enumerate(trees[t]):
            path = plain_path(levels[t], at, fanout) + plain_path(top, order.index(t), fanout)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = plain_leaf(r, int(tampered))
            for before, after in path:
                h = sha(before + h + after)
            out.append((r["doc_id"], plain_leaf(r), levels[t][-1][0], top[-1][0], sha("".join(b + a for b, a in path)), h, h == top[-1][0]))
    return out


def random_rows(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    return [{"doc_id": pick(None, i, i, i, i // 2), "text": pick(None, "", "a", "é\n" * rng.randint(1, 50)), "lang": pick(None, "en", "en", "en", "", "é", "z"), "source": pick(None, "s"), "n_chars": pick(None, 1, 2)} for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 40, 200])
def test_manifest_equals_plain(spark, n):
    rows = random_rows(n) + random_rows(n)[: n // 10]  # some rows twice
    got = merkle.verified_documents(spark.createDataFrame([tuple(r.values()) for r in rows], DOCS).withColumn("_at", F.lit(1)).withColumn("rank", F.lit(2)))
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_proofs(rows), key=key)


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.verified_documents(empty).collect() == []
    assert merkle.manifest(merkle.document_leaves(empty), ["doc_id", "leaf"]).root() is None


@pytest.mark.parametrize("fanout,n", [(2, 1), (2, 33), (2, 1025), (3, 500)])
def test_nodes_and_paths_by_interval(spark, fanout, n):
    leaves = spark.range(n).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), "id")
    m = merkle.manifest(leaves, ["id"], fanout)
    levels = plain_levels([sha(str(i)) for i in range(n)], fanout)
    nodes = {(r["level"], r["lo"], r["hi"]): r["digest"] for r in m.groups.nodes().collect()}
    assert nodes == {(k, i * fanout**k, min((i + 1) * fanout**k, n)): d for k, level in enumerate(levels) for i, d in enumerate(level)}
    assert m.root() == levels[-1][0]  # one tree: the root of roots is its root
    for r in m.proofs().collect():
        assert [(s["before"], s["after"]) for s in r["path"]] == plain_path(levels, r["id"], fanout)


def test_manifest_ranks_a_tree_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        leaves = spark.range(5000).repartition(7).select(F.when(F.col("id") % 10 > 0, "hot").alias("tree"), F.col("id").cast("string").alias("leaf"), "id")
        rows = merkle.ranked(leaves, ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for tree, n in (("hot", 4500), (None, 500)):
        mine = sorted((r["id"], r["rank"], r["n"]) for r in rows if r["tree"] == tree)
        assert [r[1] for r in mine] == list(range(n)) and {r[2] for r in mine} == {n}


# Chat formatting

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<|user|>\n", "<|>", "<<SYS>>x<</SYS>>", "", None, "</s>\n<|assistant|>\nno", "é😀[\\INST]", "a" * 9000, "😀" * 5000, "$1 \\1"]
LOG = "conv_id long, turn long, message long, seq long, kind string, role string, text string"
TABLE = "conv_id long, turn long, role string, text string"


def plain_formatted(rows):
    """(conv_id, turn, role, text) to conv_id -> (turns, formatted, loss)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))

    def broken(s):
        s = s.replace("\\", "\\\\")
        for c in chat.CONTROL:
            s = s.replace(c, c[0] + "\\" + c[1:])
        return s

    out = {}
    for conv, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        out[conv] = (turns, "<s>" + "".join(f"<|{broken(r)}|>\n{broken(t)}</s>\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant"))
    return out


def check_formatted(got, rows):
    want = plain_formatted(rows)
    found = got.select("conv_id", "formatted", "loss", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("said")).collect()
    assert sorted((r["conv_id"] is not None, r["conv_id"]) for r in found if r["conv_id"] is not None) == sorted((True, c) for c in want if c is not None) and len(found) == len(want)
    for r in found:
        turns, formatted, loss = want[r["conv_id"]]
        assert r["formatted"] == formatted
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert "".join(r["said"]) == loss
        assert all(chat_piece.count("</s>") == 0 for chat_piece in re.split("</s>\n", r["formatted"]))


def chat_rows(seed=3):
    rng = random.Random(seed)
    rows = [(conv, turn, role, rng.choice(NASTY)) for conv in (*range(12), None) for turn, role in enumerate(rng.choice([("user", "assistant"), ("system", "user", "assistant", "user", "assistant"), ("assistant",), (None, "a|>\nb", "assistant")]))]
    return rows + rows[:5] + [(3, None, "assistant", "first"), (3, 7, "assistant", "x" * 300_000)]


@pytest.mark.parametrize("long", [10_000, 3])
def test_format_round_trip(spark, long):
    rows = chat_rows()
    table = spark.createDataFrame(rows, TABLE).withColumns({"count": F.lit(1), "_conv": F.lit(2), "events": F.lit("x")})
    check_formatted(chat.format_log(chat.log_of(table), long), rows)


def plain_replay(events):
    """Text of each message after its events, one by one."""
    text = {}
    for message, _, kind, piece in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3] is not None, e[3] or "")):
        if kind == "delta":
            text[message] = text.get(message, "") + (piece or "")
        elif kind == "remove":
            text.pop(message, None)
        else:
            text[message] = (piece or "") if kind == "edit" else ""
    return text


@pytest.mark.parametrize("seed", range(5))
def test_replay_equals_loop(spark, seed):
    rng = random.Random(seed)
    events = [(rng.randrange(6), rng.randrange(8), rng.choice(["delta", "delta", "edit", "regenerate", "remove"]), rng.choice([None, "", "a", "b<s>"])) for _ in range(80)]
    log = spark.createDataFrame([(1, m, m, seq, kind, "user", text) for m, seq, kind, text in events], LOG)
    assert {r["message"]: r["text"] for r in chat.messages(log).collect()} == plain_replay(events)


def test_chat_of_nothing(spark):
    assert chat.format_log(spark.createDataFrame([], LOG)).collect() == []
    assert chat.digest_columns(chat.format_log(chat.log_of(spark.createDataFrame([], TABLE)))).collect() == []


def test_chat_query_stays_in_the_jvm(spark, sf):
    plan = queries.QUERIES["op12_chat_formatting"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Ranked search


def plain_terms(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    N, L = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = {t for t in plain_terms(text) if t in df}
        w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) for t in terms}
        rows = []
        for (doc, c), n in zip(counts, sizes):
            m = 100 - 50 + (50 * n * N) // L if L else 0
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                rows.append((score, doc))
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        out += [(item, rank + 1, doc, score) for rank, (score, doc) in enumerate(rows[:k])]
    return out


def search_fixture(seed=5, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["É", "naïve", "日本", "Zz"]
    text = lambda: " ".join(rng.choice(words if rng.random() < 0.7 else words[:3]) for _ in range(rng.choice([1, 5, 40, 300])))
    docs = [(rng.choice([i, i, i, i // 2, None]), rng.choice([None, "", "--", text(), text(), text(), text(), text()])) for i in range(n)]
    docs += [(1000 + i, docs[7][1] or "w1 w2") for i in range(120)] + docs[:20]  # copies that tie, and equal rows
    items = [(i, text()) for i in range(8)] + [(3, "W1 w1 w2"), (None, "é É"), (20, None), (21, "unknownterm")]
    return docs, items


@pytest.mark.parametrize("k,max_terms", [(10, 20_000), (50, 30)])
def test_search_equals_brute_force(spark, k, max_terms):
    docs, items = search_fixture()
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"mark": F.lit(1), "item": F.lit(2), "_id": F.lit(3)}).repartition(5)
    got = lexical.build(table).search(spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")), k=k, max_terms=max_terms)
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(docs, items, k), key=key)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lexical.build(none).search(items).collect() == []
    assert lexical.build(some).search(items.where("false")).collect() == []


def test_bounds_are_above_scores_and_exclude():
    rng = random.Random(9)
    words = [f"t{i}".encode() for i in range(3000)]
    docs = [Counter(rng.choices(words, k=rng.choice([20, 100, 400]))) for _ in range(1024)]
    terms = words[:40]
    q = lexical.Query(terms, np.arange(1000, 1040), {0: np.arange(40)}, len(docs), sum(sum(d.values()) for d in docs))
    sizes = np.array([sum(d.values()) for d in docs], np.int64)
    hashed = [(np.array([xxhash.xxh64_intdigest(t) for t in d], np.uint64), np.array(list(d.values()), np.int64)) for d in docs]
    width = lexical.BITS * 512
    slices = lexical.block_slices(hashed, width)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
    ((_, bound),) = lexical.block_bounds(q, hashes, {}, width, sizes, slices)
    scores = np.array([sum((1000 + i) * q.part(d[t], q.length(int(n))) for i, t in enumerate(terms) if d[t]) for d, n in zip(docs, sizes)])
    assert (bound >= scores).all()
    assert (bound == scores).mean() > 0.8  # bits of other terms and unknown frequencies are few
    assert (bound >= np.sort(scores)[-50]).sum() < 80
