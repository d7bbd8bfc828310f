"""Packing, decontamination, URL filter, near-duplicates, fingerprints, quality: each against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from cutframe.llm import decontaminate, fingerprint, packing, quality, queries, simhash, url_filter

# Packing


def plain_best_fit(sizes, sources, clusters, capacity):
    """Every piece looks at all bins: least room that fits, then least number."""
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fit = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= size and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        n = min(fit)[1] if fit else len(bins)
        if n == len(bins):
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((n, capacity - bins[n]["left"]))
        bins[n]["left"] -= size
        bins[n]["s"].add(s)
        bins[n]["c"].add(c)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_packing_is_best_fit(seed):
    rng = random.Random(seed)
    n, capacity = 300, 50
    sizes = sorted((rng.choice([0, 1, 7, 13, 25, 50, rng.randint(0, 50)]) for _ in range(n)), reverse=True)
    sources = [rng.choice(["hot", "hot", *"abcdefgh", None]) for _ in range(n)]
    clusters = [rng.choice([None, 1, 2, 3, rng.randint(4, 400)]) for _ in range(n)]
    got = packing.pack_shard(sizes, sources, clusters, capacity)
    assert list(zip(*got)) == plain_best_fit(sizes, sources, clusters, capacity)


def check_packing(rows, docs, capacity):
    bins = defaultdict(list)
    total = defaultdict(int)
    for r in rows:
        bins[r["bin_id"]].append(r)
        total[r["doc_id"]] += r["size"]
        assert 0 <= r["size"] <= capacity and r["start"] == r["piece"] * capacity
    for members in bins.values():
        members.sort(key=lambda r: (r["bin_offset"], r["size"]))
        at = 0
        for r in members:
            assert r["bin_offset"] == at
            at += r["size"]
        assert at <= capacity
        for name in ("source", "cluster"):
            known = [r[name] for r in members if r[name] is not None]
            assert len(known) == len(set(known)), (name, members)
    assert dict(total) == docs


def test_packing_tables(spark, sf):
    docs = {r["doc_id"]: len(r["text"].split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_packing(queries.op1_best_fit_packing(spark, sf).collect(), docs, packing.CAPACITY)


def test_packing_odd_rows(spark):
    rows = [(1, 5, "a", 1), (1, 5, "a", 1), (2, None, None, None), (3, -4, "a", 2), (4, 25, "b", 2), (None, 3, "c", None), (5, 0, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, units int, source string, cluster long").withColumns({"piece": F.lit("x"), "shard": F.lit(9), "bin_id": F.lit("y")})
    out = packing.pack(docs, "units", capacity=10, shard_pieces=2).collect()
    check_packing(out, {1: 10, 2: 0, 3: 0, 4: 25, None: 3, 5: 0}, 10)
    assert packing.pack(docs.limit(0), "units").count() == 0
    texts = spark.createDataFrame([(1, "a b c d e"), (4, " ".join(map(str, range(25))))], "doc_id long, text string")
    packed = packing.pack(spark.createDataFrame([(1, 5, "a", 1), (4, 25, "b", 2)], "doc_id long, units int, source string, cluster long"), "units", capacity=10)
    words = sorted(w for r in packing.bin_texts(texts, packed).collect() for w in r["text"].split())
    assert words == sorted([*"abcde", *map(str, range(25))])


def test_packing_keeps_ids_and_spreads_rows_without_one(spark):
    big = (1 << 53) + 1
    rows = [(None if i % 3 else big + i, 5, "s", f"c{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, units int, source string, cluster string").coalesce(1)
    out = packing.pack(docs, "units", capacity=10, shard_pieces=100).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted(r[0] for r in rows if r[0] is not None)
    assert len({r["bin_id"] >> 32 for r in out if r["doc_id"] is None}) == 9
    check_packing(out, {None: 3000, **{r[0]: 5 for r in rows if r[0] is not None}}, 10)
    long = spark.createDataFrame([(1, 3_000_000, "s", "c")], "doc_id long, units int, source string, cluster string")
    assert len({r["bin_id"] >> 32 for r in packing.pack(long, "units", shard_pieces=100).collect()}) > 10  # counted in pieces


def test_windows_carry_texts(spark):
    rows = [(i, 0, i % 7 + 1, f"s{i % 5}", None, f"text {i}", 0) for i in range(60)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, size long, source string, cluster string, text string, start long")
    got = packing.pack_windows(cut, 10, 16).collect()
    assert sorted(p["text"] for r in got for p in r["pieces"]) == sorted(r[5] for r in rows)
    for r in got:
        assert r["size"] == sum(p["size"] for p in r["pieces"]) <= 10 and r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
        assert len({p["doc_id"] % 5 for p in r["pieces"]}) == len(r["pieces"])
        assert [p["bin_offset"] for p in r["pieces"]] == [sum(p["size"] for p in r["pieces"][:i]) for i in range(len(r["pieces"]))]
    assert packing.pack_windows(cut.limit(0)).count() == 0


# Decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_contamination(docs, items):
    grams = defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[i : i + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[tuple(w[i : i + size])]
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def contaminated_rows(seed):
    rng = random.Random(seed)
    words = [*"abcdefgh", "É", "é", "Ça", "K", "x1"]
    text = lambda n: rng.choice([" ", "  ", ", "]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 8, 12, 13, 14, 30, 0])]
    items = [(i, t if i > 1 else t + " zzq" + str(i)) for i, t in items] + [(99, None), (98, items[8][1]), (3, "ein anderes")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, text(5) + " " + t + " " + text(7)) for i, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, items[8][1].upper()), (0, docs[0][1]), (None, items[7][1])]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 1_000_000), (2, 1_000_000), (3, 7)])
def test_contamination_equals_brute_force(spark, seed, block):
    docs, items = contaminated_rows(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"w": F.lit(1), "key": F.lit(2), "size": F.lit(3), "item_id": F.lit(4)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit("x"))
    got = decontaminate.contamination(d, b, max_windows=block).drop("spans", "key").collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(docs, items)


def test_decontamination_removes_documents_or_spans(spark):
    docs, items = contaminated_rows(5)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {(r[0], r[1]) for r in plain_contamination(docs, items) if r[5]}
    kept = decontaminate.decontaminate(d, b).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(((k, t) for k, t in docs if (k, len(WORD.findall(low(t)))) not in bad), key=str)
    cut = decontaminate.decontaminate(d, b, mode="spans")
    assert cut.count() == len(docs) and cut.columns == ["doc_id", "text", "key"]
    left = {r[0]: r for r in plain_contamination([(r["doc_id"], r["text"]) for r in cut.where("doc_id IS NOT NULL").dropDuplicates().collect()], items)}
    for doc, n, hit, *_ in plain_contamination([x for x in docs if x[0] is not None], items):
        assert left[doc][1] == n - hit
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert decontaminate.contamination(d, b.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(d, b, mode="words")


# URL filter


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, max(fits)[1], max(fits)[2])
    spam = any(w in host for w in url_filter.LISTED_WORDS) and path.startswith("/")
    return (host, path, None, "block" if spam else "allow")


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "https://x.example.net/en/1?q=/en/", "https://example.net/en", "http://a.b.example.com/de/x#f", "http://example.com/DE/x", "http://notorg/fr/", "http://w.org/fr/a/b/c/d",
        "http://m.casino-win.example.com/en/1", "http://CASINO.example.net/en/", "http://CASINO.example.net/x", "ftp://u@casino.org/fr/x", "http://casino.org?x", "a://b://net/", "http://example.com./de/", "http://..net/", "http://net//", "x://É.NET/é"]


@pytest.mark.parametrize("max_bits", [url_filter.MAX_BITS, 8])
def test_urls_equal_brute_force(spark, max_bits):
    rows = [(i, u, "k", 3, "a", "b", "c", "d") for i, u in enumerate([*URLS, URLS[5]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string, hits int, host string, verdict string, row string, listed string")
    found = url_filter.judge_urls(pages, max_bits=max_bits).collect()
    got = {r["page_id"]: tuple(r["judged"][c] for c in ("host", "path", "rule", "verdict")) for r in found}
    assert got == {i: plain_verdict(u) for i, u in enumerate([*URLS, URLS[5]])}
    assert sorted(tuple(r)[:-1] for r in found) == sorted(rows)  # nothing of the input is overwritten
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("max_bits", [url_filter.MAX_BITS, 1500])
def test_a_long_list_of_pages_and_folders(spark, max_bits):
    rng = random.Random(8)
    urls = [f"https://{rng.choice(('', 'm.', 'a.b.'))}h{rng.randrange(40)}.example.com/x/{rng.randrange(60)}{rng.choice(('', '/', '/y'))}" for _ in range(4000)]
    keys = {f"h{rng.randrange(40)}.example.com/x/{rng.randrange(60)}{rng.choice(('', '/'))}" for _ in range(900)} | {"h7.example.com/", "elsewhere.net/x"}
    listed = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")

    def blocked(url):
        host, path = re.fullmatch(r"https://([^/]*)(/.*)", url).groups()
        fits = lambda h, p: (host == h or host.endswith("." + h)) and (path == p or p.endswith("/") and path.startswith(p))
        return any(fits(*re.fullmatch(r"([^/]*)(/.*)", k).groups()) for k in keys)

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["judged"]["verdict"] == "block" for r in url_filter.judge_urls(pages, listed, rules=(("none.org", "/", "allow"),), max_bits=max_bits).collect()}
    assert got == {i: blocked(u) for i, u in enumerate(urls)}


def test_the_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).withColumn("listed", F.expr("hash(key) % 7 = 0"))
    levels = url_filter.build_cascade(keys)
    assert len(levels) > 2
    assert keys.where(url_filter.is_listed(F.col("key"), levels) != F.col("listed")).count() == 0
    assert url_filter.build_cascade(keys.where("NOT listed")) == [] and len(url_filter.build_cascade(keys.where("listed"))) == 1


def test_a_million_listed_keys(spark):
    keys = spark.range(3_000_000).select(F.concat(F.lit("host"), F.col("id"), F.lit(".com/")).alias("key")).withColumn("listed", F.expr("hash(key) % 3 = 0"))
    levels = url_filter.build_cascade(keys)
    assert sum(x.bits for x in levels) < url_filter.MAX_BITS and url_filter.parts(1_000_000, 2_000_000, url_filter.MAX_BITS) == 1
    assert keys.where(url_filter.is_listed(F.col("key"), levels) != F.col("listed")).count() == 0


# Near-duplicates


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(text)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in bits) > len(bits))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints_equal_brute_force(spark):
    texts = ["", None, " \t\x0b\x0c", "One", "one TWO", "a b c", "a b c d a b c d", "É é\u00a0x y", "x " * 1000, "K İ ß z", "a\x1cb c d e"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(simhash.fingerprint_hex(simhash.simhash(F.col("text"))).alias("h")).collect()
    assert [r["h"] for r in got] == [f"{plain_fingerprint(t):016x}" for t in texts]


def noisy_fingerprints(seed, groups, size, most):
    rng = random.Random(seed)
    out = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, most)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed,groups,size,most,hot", [(1, 60, 8, 3, 2000), (2, 5, 60, 5, 2000), (3, 4, 80, 4, 3), (4, 1, 300, 6, 2)])
def test_links_join_what_brute_force_joins(spark, seed, groups, size, most, hot):
    prints = noisy_fingerprints(seed, groups, size, most)
    signed = [simhash._signed(x) for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)
    got = {x: x for x in signed} | {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = plain_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert got == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (3, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}


def test_near_duplicates_of_the_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = {k: plain_fingerprint(t) for k, t in docs}
    want = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_near_dedup(spark, sf).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


def test_deduplicate_odd_rows(spark):
    rows = [(4, "a b c d"), (2, "A b  c d"), (2, "A b  c d"), (7, None), (6, ""), (None, "a b c d"), (9, "quite another text of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1)})
    kept = sorted(simhash.deduplicate(docs).collect(), key=str)
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "6", "9", "None"] and kept[0]["fp"] == "x"
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


# Document fingerprints


def test_peeling_recovers_the_differences(spark):
    rng = random.Random(9)
    rows = []
    for n in (0, 1, 5, 20, 80, 400):
        pool = [rng.getrandbits(64) - (1 << 63) for _ in range(3 * n + 1)]
        rows += [(pool[: 2 * n], pool[n:]), (pool[:n], pool[:n]), (pool[:n], []), ([], pool[: n // 2]), (pool[:n], pool[n : 3 * n])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", fingerprint.differing(F.col("a"), F.col("b")).alias("d"), fingerprint.likeness(F.col("a"), F.col("b")).alias("l"))
    for r in df.collect():
        a, b = set(r["a"]), set(r["b"])
        assert sorted(map(tuple, r["d"])) == sorted([(k, 1) for k in a - b] + [(k, -1) for k in b - a])
        assert r["l"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_sketch_text_round_trip(spark):
    df = spark.createDataFrame([("a b c\n" * 3 + "tail words",), ("",), (None,)], "text string")
    cells = df.select(fingerprint.sketch(fingerprint.digests(F.col("text")), F.lit(0)).alias("c"), fingerprint.decode(fingerprint.fingerprint(F.col("text"))).alias("d")).collect()
    assert all(r["c"] == r["d"] for r in cells) and cells[1] == cells[2] != cells[0]


def test_stored_fingerprints_compare(spark):
    base = [f"line {i} of the text" for i in range(40)]
    texts = ["\n".join(base), "\n".join(base[:36] + ["new words", "and more"]), "\n".join(f"other {i}" for i in range(60)), "", None]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    rows = df.select("a", "b", fingerprint.stored_likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("l")).collect()
    sets = {t: set((t or "").splitlines()) for t in texts}
    for r in rows:
        a, b = sets[r["a"]], sets[r["b"]]
        if len(a ^ b) <= 6:
            assert r["l"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        else:
            assert r["l"] is None or r["l"] == pytest.approx(len(a & b) / len(a | b))
    assert sum(r["l"] is None for r in rows) >= 8  # 40 differing digests do not come out of 24 cells
    with pytest.raises(TypeError):
        fingerprint.version_fingerprints(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_next_document(spark, range_rows):
    rng = random.Random(3)
    rows = [(i, f"text {i}") for i in rng.sample(range(-50, 10_000), 100)] + [(7_000_000, "far")]
    order = sorted(rows)
    want = {r[0]: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), range_rows).collect()
    assert {r["doc_id"]: r["next_text"] for r in got} == want and len(got) == len(rows)
    with_nulls = spark.createDataFrame([*rows, (None, "none")], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(with_nulls, range_rows).collect()}
    assert got[None] == order[0][1] and got[order[-1][0]] == "none"


def test_version_fingerprints(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in queries.op10_version_fingerprints(spark, sf).collect()}
    units = lambda t: {u.rstrip(" ") for u in re.findall(r"(?:\S+[^\S\n]*){1,%d}" % fingerprint.UNIT_WORDS, t)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = defaultdict(set)
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = rows[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(units(text), units(edited))) and r["near_next"] == pytest.approx(like(units(text), units(after)))
        prints[text].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_version_fingerprints_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a\n" * 5000), (None, "x y z w")], "doc_id long, text string").withColumns({"range": F.lit(1), "mark": F.lit(2), "own": F.lit(3)})
    out = fingerprint.version_fingerprints(docs).collect()
    assert len(out) == 5 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert fingerprint.version_fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.version_fingerprints(docs.where("doc_id = 3")).first()["near_next"] == 1.0


# Quality


def test_quality_on_held_out_labels(spark, sf):
    big = f"{sf}/../sf0.1"
    scored = queries.op3_quality_classifier(spark, big)
    rows = scored.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 500
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    kept = sum(r["predicted"] for r in rows if r["quality"] == 1) / sum(r["quality"] == 1 for r in rows)
    print(f"held-out accuracy {right:.4f}, good kept {kept:.4f}, rows {len(rows)}")
    assert right >= 0.95 and kept >= 0.98
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert scored.count() == spark.read.parquet(f"{big}/documents.parquet").count()


def test_quality_rules_are_conjunctions(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert model.rules and all(1 <= len(r.terms) <= quality.DEPTH for r in model.rules)
    import math

    stats = quality.with_statistics(docs).select("_row.doc_id", *quality.NAMES)
    rows = quality.score(docs.select("doc_id", "text"), model).join(stats, "doc_id").collect()
    for r in rows[:200]:
        total = model.intercept + sum(rule.weight for rule in model.rules if all((r[n] > b) == above for n, above, b in rule.terms))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_without_enough_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (3, "")], "doc_id long, text string").withColumns({"upper": F.lit(1), "label": F.lit(2)})
    for labels, want in (([(1, 1), (2, 1), (3, None)], 0.99), ([], 0.5), ([(1, 0)], 0.01)):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = quality.score(docs, model).collect()
        assert len(out) == 4 and all(r["score"] == pytest.approx(want) for r in out) and out[0]["upper"] == 1
    assert quality.score(docs.limit(0), quality.Model((), 0.0)).count() == 0


def test_packing_counts_pieces_and_leaves_null_texts_apart(spark):
    long = spark.createDataFrame([(k, 40, None, None) for k in range(5)], "doc_id long, units long, source string, cluster string")
    rows = packing.pack(long, "units", capacity=4, shard_pieces=5).collect()
    assert len(rows) == 50 and len({r["bin_id"] >> 32 for r in rows}) > 1  # one shard for each five pieces, not documents
    texts = spark.createDataFrame([(1, None), (2, None), (3, "A "), (4, "a")], "doc_id long, text string")
    got = {r["doc_id"]: r["c"] for r in texts.select("doc_id", packing.content_cluster(F.col("text")).alias("c")).collect()}
    assert got[1] is None and got[2] is None and got[3] == got[4] is not None


def test_deduplicate_keeps_unrelated_texts_of_one_id(spark):
    docs = spark.createDataFrame([(2, "A b  c d"), (2, "a b c d"), (2, "quite another text of words"), (4, "a b c d")], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"].lower().split()[0]) for r in simhash.deduplicate(docs).collect())
    assert kept == [(2, "a"), (2, "quite")]


def plain_statistics(text):
    """The statistics of a text, counted in plain Python."""
    body = text or ""
    words = re.split(r"[ \t\n\x0b\f\r]+", body.lower())
    chars, n = max(1, len(body)), max(1, len(words))
    count = lambda p: len(regex.findall(p, body))
    echo, at, parts = 0, 0, body.split()
    while at + 1 < len(parts):
        echo, at = (echo + 1, at + 2) if parts[at] == parts[at + 1] else (echo, at + 1)
    return {
        "log_chars": math.log1p(chars), "mean_word": chars / n, "distinct_words": len(set(words)) / n, "upper": count(r"\p{Lu}") / chars, "digit": count("[0-9]") / chars,
        "symbol": sum(c in "#$%&*|<>{}[]=~^_@\\" for c in body) / chars, "stop": count("[.?]") / n, "comma": count("[,;:]") / n, "bang": body.count("!") / n, "line_break": body.count("\n") / n, "echo": echo / n,
    }


def test_scores_equal_rules_in_plain_python(spark, sf):
    """Every whole text's score by the fitted rules, from statistics that are counted anew."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "A b b, c! \n12 $")], "doc_id long, text string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    assert model.rules
    for r in quality.score(docs, model).collect():
        found = plain_statistics(r["text"])
        total = model.intercept + sum(rule.weight for rule in model.rules if all((found[name] > bound) == above for name, above, bound in rule.terms))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), r["doc_id"]


def test_a_forest_that_cannot_be_read_is_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "Good words, here. " * 5 if i % 2 else "#$% 12 !!") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "tree_rules", lambda described, names: [])
    with pytest.raises(RuntimeError):
        quality.fit(docs, labels)
