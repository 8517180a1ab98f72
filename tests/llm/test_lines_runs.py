"""Line deduplication and periodic runs against plain loops."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import line_dedup, periodic_runs, registry
from tests.llm.cases import awkward, documents, prose, sha

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def key(line):
    return line.strip(BLANK).translate(LOWER)


def kept_lines(rows, least_chars, least_docs):
    """For each row its lines and which of them stay."""
    held = defaultdict(set)
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held[key(line)].add(i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        out.append([(line, not (len(held.get(key(line), ())) >= least_docs and max(held[key(line)]) != i)) for line in lines])
    return out


def line_rows():
    r, common = random.Random(4), [prose(f"line{k}", 9) + " padded to be long enough" for k in range(12)]
    rows = awkward()
    for i in range(100, 160):
        lines = [r.choice(common[: r.choice([2, 12])]) for _ in range(r.randint(0, 6))] + [prose(f"{i}/{k}", r.randint(1, 12)) for k in range(r.randint(0, 4))]
        r.shuffle(lines)
        lines = [r.choice(["", " ", "\t\x0b", "\r"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", " \r"]) for x in lines]
        rows.append((i if r.random() < 0.9 else None, "\n".join(lines), "a"))
    rows += [(100, common[0] + "\n" + common[0], "b"), (300, "\n".join([common[1]] + ["x"] * 200 + [common[1].swapcase()]), "b"), (301, common[0], "b"), (301, common[0], "b")]
    # as long as the limit, one shorter, and with white space that is not stripped
    for i in range(310, 318):
        rows.append((i, "a" * 40 + "\n" + "b" * 39 + "\n " + "c" * 40, "b"))
    return rows


@pytest.mark.parametrize("hot", [1, 1024])
@pytest.mark.parametrize("least", [(40, 5), (1, 2)])
def test_line_dedup_equals_plain_loops(spark, hot, least):
    """hot 1024: every hash of this small table is hot; hot 1: none is."""
    rows = line_rows()
    want = sorted((str(i), len(lines), sum(not k for _, k in lines), "\n".join(x for x, k in lines if k)) for (i, _, _), lines in zip(rows, kept_lines(rows, *least), strict=True))
    got = line_dedup.dedup(documents(spark, rows).withColumns({"_a": F.lit(1), "_h": F.lit(2), "keep": F.lit(3)}), *least, hot).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == want


def test_bitmaps_hold_only_words_with_a_dropped_line(spark):
    rows = [(i, "\n".join(["x" * 50] + ["y"] * 100 + ["z" * 60]), "a") for i in range(6)]
    marks = line_dedup.keep_bitmaps(documents(spark, rows)).collect()
    assert len(marks) == 5
    assert {tuple((w["word"], w["bits"]) for w in m["keep"]) for m in marks} == {((0, ~1), (1, ~(1 << 37)))}


def test_line_dedup_of_no_rows(spark):
    assert line_dedup.dedup(documents(spark, [])).collect() == []


def test_line_hashes_are_shuffled_once_and_texts_not_before(spark, tmp_path):
    documents(spark, line_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    plan = registry.op11_line_dedup(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_runs(words, least, times):
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b, q) for (a, b), q in found.items())


def test_runs_equal_plain_loops():
    r = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 5)):
            words: list[int] = []
            while len(words) < r.choice([0, 5, 60, 200]):
                unit = [r.randint(0, r.choice([1, 3, 50])) for _ in range(r.randint(1, 25))]
                words += (unit * 9)[: r.randint(1, len(unit) * 8)]
            texts.append(words)
        least, times = r.choice([(24, 3), (24, 3), (2, 2), (10, 2), (5, 4)])
        starts = np.cumsum([0] + [len(t) for t in texts])
        got = periodic_runs.find_runs(np.array([w for t in texts for w in t], np.int64), starts, least, times)
        want = [(a + s, b + s, q) for t, s in zip(texts, starts.tolist(), strict=False) for a, b, q in brute_runs(t, least, times)]
        assert [tuple(x) for x in got.tolist()] == want


def planted(i, words):
    h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def expected(i, text):
    import re

    words = planted(i, re.findall("[^\x20\x09-\x0d]+", text or ""))
    runs = sorted((a, b - a, q) for a, b, q in brute_runs(words, 24, 3))
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    from fractions import Fraction

    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return (str(i), len(runs), *best, milli, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_runs_query_equals_plain_loops(spark, tmp_path):
    r = random.Random(2)
    rows = [x for x in awkward() if len(x[1] or "") < 4000 or " " not in x[1]]
    rows += [(i, prose(i, r.randint(1, 300)), "a") for i in range(100, 180)]
    rows += [(200, " ".join(["ab", "c"] * 40), "a"), (201, "x " * 24, "a"), (202, "x\t" * 23, "a"), (203, " ".join(["p q r"] * 9 + ["s"] + ["p q r"] * 9), "a"), (204, "A a " * 30, "a")]
    rows += [(205, " ".join(["u v"] * 12 + ["w x y"] * 12), "a"), (206, " ".join(prose(5, 400).split() * 3), "a"), (206, " ".join(prose(5, 400).split() * 3), "a")]
    documents(spark, rows).withColumn("runs", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(str(x) if k == 0 else x for k, x in enumerate(r)) for r in registry.op13_periodic_runs(spark, str(tmp_path)).collect())
    want = sorted((expected(i, text) for i, text, _ in rows), key=lambda x: tuple(map(str, x)))
    assert sorted(got, key=lambda x: tuple(map(str, x))) == want
    assert any(x[1] > 1 for x in want)


def test_a_long_text_and_no_rows(spark):
    long_ = " ".join([*prose(9, 30000).split(), *(["loop", "of", "words"] * 9000)])
    found = periodic_runs.collapse(documents(spark, [(1, long_, "a")])).first()
    assert (found["n_runs"], found["period"], found["length"] >= 27000) == (1, 3, True)
    assert periodic_runs.collapse(documents(spark, [])).collect() == []
