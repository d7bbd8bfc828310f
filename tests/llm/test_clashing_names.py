"""Operators that return their input's columns: columns with the names they use inside come through untouched."""

import pytest

from cutframe.llm import decontaminate, near_copies, pii, secrets, simhash
from cutframe.llm.common import unused

NAMES = ("_spans", "_secrets", "_id", "_key", "_fp", "_keep", "_kept_fp", "_class", "_cls", "_swapped", "__class", "key", "fp", "cls")
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen password=hunter22 a@b.example"


def documents(spark):
    rows = [(1, TEXT, *(f"{n}1" for n in NAMES)), (2, "something else", *(f"{n}2" for n in NAMES)), (3, TEXT, *(f"{n}3" for n in NAMES)), (None, None, *(None for _ in NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def items(spark):
    return spark.createDataFrame([(7, TEXT)], "item_id long, text string")


OPERATORS = {
    "find_secrets": (lambda spark, docs: secrets.find_secrets(docs), [None, 1, 2, 3]),
    "redact": (lambda spark, docs: secrets.redact(docs), [None, 1, 2, 3]),
    "decontaminate": (lambda spark, docs: decontaminate.decontaminate(docs, items(spark)), [None, 2]),
    "decontaminate_spans": (lambda spark, docs: decontaminate.decontaminate(docs, items(spark), mode="spans"), [None, 1, 2, 3]),
    "simhash": (lambda spark, docs: simhash.deduplicate(docs), [None, 1, 2]),
    "near_copies": (lambda spark, docs: near_copies.deduplicate(docs), [None, 1, 2]),
    "pseudonymize": (lambda spark, docs: pii.pseudonymize(docs, counts="found"), [None, 1, 2, 3]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    operator, ids = OPERATORS[name]
    rows = operator(spark, documents(spark)).collect()
    assert sorted(rows, key=lambda r: r["doc_id"] or 0) and sorted((r["doc_id"] or 0) for r in rows) == [i or 0 for i in ids]
    for r in rows:
        assert all(r[n] == (f"{n}{r['doc_id']}" if r["doc_id"] else None) for n in NAMES)


def test_unused(spark):
    assert unused(spark.range(1).selectExpr("id AS _A", "id AS __a"), "_a") == "___a"
