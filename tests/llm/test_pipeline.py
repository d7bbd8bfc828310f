"""Every stage of the pipeline against a plain version of its decision, on its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from cutframe.llm import pii, quality, token_counts
from test_corpus_operators import plain_contamination
from test_near_copies import plain_roots


def check_windows(rows, before):
    """Every text comes back whole from its pieces; no window is too long or holds two pieces of one source."""
    encoding, _ = token_counts.load(token_counts.VOCABULARY)
    pieces = {}
    for r in rows:
        assert r["size"] == sum(p["size"] for p in r["pieces"]) <= 2048 and r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
        sources = [before[p["doc_id"]]["source"] for p in r["pieces"] if before[p["doc_id"]]["source"] is not None]
        assert len(set(sources)) == len(sources)
        for p in r["pieces"]:
            pieces.setdefault(p["doc_id"], []).append((p["piece"], p["size"], p["text"] or ""))
    assert pieces.keys() == before.keys()
    for key, own in pieces.items():
        assert "".join(t for _, _, t in sorted(own)) == (before[key]["text"] or "")
        assert sum(n for _, n, _ in own) == len(encoding.encode_ordinary(before[key]["text"] or ""))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "personal_data", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name == "packing":
            check_windows(rows, before)
            continue
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows)
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out(F.col("doc_id"))))
            want = {r["doc_id"] for r in quality.score(docs, model).where("score >= 0.3").collect()}
            assert set(after) == want
        elif name == "near_copies":
            assert set(after) == set(plain_roots({k: r["text"] for k, r in before.items()}).values())
        elif name == "benchmark":
            assert set(after) == {r[0] for r in plain_contamination([(k, r["text"]) for k, r in before.items()], benchmark) if not r[5]}
        elif name == "personal_data":
            run = pii.replacer(pii.session_key(spark))
            assert {k: r["text"] for k, r in after.items()} == {k: run(r["text"])[0] for k, r in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            assert not any(re.search(r"@mail\d", m) for k, r in after.items() for m in re.findall(r"\S+@\S+", r["text"]) if m in before[k]["text"])
        if name != "personal_data":
            assert all(after[k] == before[k] for k in after)
        docs, before = out, after


def test_run_equals_its_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", None, None, 5), (2, None, "en", "s", 0), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(k for r in rows for k in r["doc_ids"]) == [1, 2]  # the empty texts are copies of each other
