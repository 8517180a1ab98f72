"""Ranked lexical search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import lexical_search
from tests.llm.cases import awkward, documents, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t, _ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, length = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        said, scored = Counter(terms(text)), []
        for at, (i, c, size) in enumerate(docs):
            m = 100 - 75 + (75 * size * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in said.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, at))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    rows = [x for x in awkward() if len(x[1] or "") < 6000]
    rows += [(100 + i, prose(i, r.choice([2, 8, 40, 200])), "a") for i in range(120)]
    rows += [(400 - i, prose(7, 60), "copies") for i in range(40)]
    rows += [(None, prose(7, 60), "copies"), (405, "The THE the É é", "a"), (405, "The THE the É é", "a")]
    items = [(i, prose(i, 30)) for i in range(12)] + [(20, prose(7, 20)), (21, "the"), (22, "nowhereword"), (23, None), (24, ""), (25, "É the the é"), (20, prose(7, 20)), (None, prose(3, 9)), (26, prose(1, 300))]
    return rows, items


def asked(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")


@pytest.mark.parametrize("k", [1, 10])
def test_search_equals_a_plain_scan(spark, k, monkeypatch):
    rows, items = corpus()
    monkeypatch.setattr(lexical_search, "BLOCK", 40)
    monkeypatch.setattr(lexical_search, "STEP", 300)
    given = documents(spark, rows).withColumns({"row": F.lit("x"), "term": F.lit(1)})
    got = sorted((tuple(r) for r in lexical_search.search(given, asked(spark, items), k).collect()), key=str)
    assert got == ranked(rows, items, k)


def test_lots_of_queries_do_not_change_results(spark, monkeypatch):
    rows, items = corpus()
    monkeypatch.setattr(lexical_search, "LOT_BYTES", 2000)
    got = sorted((tuple(r) for r in lexical_search.search(documents(spark, rows), asked(spark, items)).collect()), key=str)
    assert got == ranked(rows, items, 10)


def test_search_without_documents_or_queries(spark):
    rows, items = corpus()
    assert lexical_search.search(documents(spark, []), asked(spark, items)).collect() == []
    assert lexical_search.search(documents(spark, rows), asked(spark, [])).collect() == []
    assert lexical_search.search(documents(spark, rows), asked(spark, [(1, None), (2, "-")])).collect() == []
    assert lexical_search.search(documents(spark, rows), asked(spark, [(1, "nowhereword")])).collect() == []


def test_thresholds_leave_entries_unread(spark):
    """A list of small weight is not read where the bound is high."""
    rows = [(i, "common " + prose(i, 10), "a") for i in range(200)] + [(500 + i, "rare words here together", "a") for i in range(12)]
    queries = lexical_search.Queries(["rare words here together common"])
    assert len(queries.term) == 5
    got = lexical_search.search(documents(spark, rows), asked(spark, [(1, "rare words here together common")])).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [500 + i for i in range(10)]
