"""Near copies against brute-force Jaccard similarity."""

import random

import pytest
from pyspark.sql import functions as F

from cutframe.llm import near_copies, pipeline
from test_corpus_operators import plain_components


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_roots(texts):
    sets = {k: plain_set(t) for k, t in texts.items()}
    return plain_components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def varied(seed, groups, size, most, common=0):
    rng = random.Random(seed)
    line = [f"c{i}" for i in range(common)]
    out = {}
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((4, 30, 120, 200)))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, most)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(300)}"
            out[len(out) + 1] = " ".join(line + words[rng.randrange(3) :])
    return out


@pytest.mark.parametrize("seed,groups,size,most,common,hot", [(1, 40, 5, 5, 0, 64), (2, 30, 8, 4, 60, 64), (3, 3, 60, 6, 20, 3), (4, 2, 90, 8, 0, 10)])
def test_near_copies_equal_brute_force(spark, seed, groups, size, most, common, hot):
    texts = varied(seed, groups, size, most, common)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_roots(texts)
    assert 1 < len(set(want.values())) < len(want)
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(docs, hot_shingle=hot).collect()) == sorted(set(want.values()))


def test_near_copies_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_roots({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"] for r in pipeline.no_near_copies(spark, docs, sf).collect()}
    assert got == set(want.values()) and not got & {145, 177}  # similar by 0.83, 7 and 11 bits apart


def test_simhash_joins_what_is_in_its_ball(spark):
    texts = varied(4, 6, 60, 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select(near_copies.text_class(F.col("text")).alias("cls"), "text")
    sets = {r["cls"]: plain_set(r["text"]) for r in docs.collect()}
    close = near_copies.close_links(docs).collect()
    assert len(close) > 20 and all(5 * len(sets[r["a"]] & sets[r["b"]]) >= 4 * len(sets[r["a"]] | sets[r["b"]]) for r in close)


def test_odd_rows(spark):
    rows = [(4, "a b c d"), (2, "A b  c d"), (2, "A b  c d"), (2, "unlike the others"), (7, None), (6, " \n"), (None, "a b c d"), (9, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("x"))
    kept = near_copies.deduplicate(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["cls"]) for r in kept) == [("2", "A b  c d", "x"), ("2", "unlike the others", "x"), ("6", " \n", "x"), ("9", "a b c d e", "x"), ("None", "a b c d", "x")]
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def classes_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").select(near_copies.text_class(F.col("text")).alias("cls"), "text")


def plain_class_roots(docs):
    return plain_roots({r["cls"]: r["text"] for r in docs.collect()})


@pytest.mark.parametrize("seed,groups,size,most,common", [(3, 3, 60, 6, 20), (5, 2, 90, 9, 0), (6, 40, 4, 2, 90)])
def test_large_hot_groups_by_pivots(spark, seed, groups, size, most, common):
    """With small bounds every hot shingle goes through rounds of pivots over several blocks."""
    docs = classes_of(spark, varied(seed, groups, size, most, common))
    want = plain_class_roots(docs)
    found = near_copies.links(docs, hot_shingle=3, local_shingles=100, block_shingles=2000)
    got = {r["node"]: r["root"] for r in near_copies.components(found).collect()}
    assert {c: got.get(c, c) for c in want} == want


def test_pivots_without_links(spark):
    """Classes on one shingle that are not similar: every one is a pivot in the end, and nothing is linked."""
    texts = {i: " ".join([f"c{j}" for j in range(8)] + [f"u{i}x{j}" for j in range(30)]) for i in range(70)}
    docs = classes_of(spark, texts)
    sets = docs.select("cls", near_copies._sets("text").alias("shingles"))
    hot = docs.select(F.lit(1).cast("long").alias("hash"), "cls", F.lit(34).alias("size"))
    none = spark.createDataFrame([], "a long, b long")
    assert near_copies._pivoted(hot, sets, none, 500).count() == 0


def test_fronts_dealt_twice_are_the_same(spark):
    docs = classes_of(spark, varied(7, 6, 30, 5, 30))
    once, twice = (sorted(map(tuple, near_copies.fronts(docs, *sizes).collect())) for sizes in ((near_copies.TASK_SHINGLES, near_copies.DEAL), (40, 8)))
    assert once and once == twice


def test_frequent_shingles_come_last(spark):
    line = " ".join(f"c{i}" for i in range(20))
    texts = {i: f"{line} " + " ".join(f"u{i}x{j}" for j in range(3)) for i in range(100)}
    docs = classes_of(spark, texts)
    hashes, place = near_copies.frequent_shingles(docs, 2300)
    shared = set.intersection(*(set(near_copies.shingle_set(t).tolist()) for t in texts.values()))
    assert set(hashes.tolist()) == shared and len(shared) == 16 and sorted(hashes.tolist()) == hashes.tolist()
    assert sorted(place.tolist()) == list(range(near_copies.LAST - 15, near_copies.LAST + 1))
    fronts = near_copies.fronts(docs).collect()
    assert len(fronts) == 100 and all(r["at"] == 3 and r["size"] == 19 and r["hash"] % 2**64 in shared for r in fronts)
