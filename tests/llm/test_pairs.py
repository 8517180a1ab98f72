import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import bytewords, components, decontamination, fingerprints, jaccard, packing
from tests.llm.cases import awkward, documents, prose, sha

LOWER = {c: c + 32 for c in range(65, 91)}
UPPER = {c + 32: c for c in range(65, 91)}


def plain_words(text, pattern=r"[^\x20\x09-\x0d]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def shingle_set(text, width):
    w = plain_words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def linked_components(rows, width, num, den):
    sets = [(i, shingle_set(t, width)) for i, t, _ in rows if i is not None]
    top = {i: i for i, _ in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return {i: root(i) for i in top}


def edited(text, r, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = prose(r.random(), 1)
    return " ".join(w)


def family(seed, count, words, share):
    """Texts that drift away from one another."""
    r = random.Random(seed)
    out = [prose(seed, words)]
    while len(out) < count:
        out.append(edited(r.choice(out[-5:]), r, share))
    return out


def test_words_equal_a_regular_expression():
    import pyarrow as pa

    texts = [t for _, t, _ in awkward()] + ["A\x0bB", "é É ẞ", " lead", "trail ", "\x00 \x00"]
    for table, pattern in ((bytewords.SPACE, r"[^\x20\x09-\x0d]+"), (bytewords.NON_ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
            hashes, starts = bytewords.words(array, table)
            want = [plain_words(t, pattern) for t in texts]
            assert np.diff(starts).tolist() == list(map(len, want))
            seen = {}
            for h, w in zip(hashes.tolist(), (w for ws in want for w in ws), strict=True):
                assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)


def test_words_of_a_text_longer_than_a_slice(monkeypatch):
    import pyarrow as pa

    texts = ["a b", prose(3, 3000), "y" * 900, "", "c"]
    whole = bytewords.words(pa.array(texts))
    monkeypatch.setattr(bytewords, "SLICE", 64)
    small = bytewords.words(pa.array(texts))
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))


@pytest.mark.parametrize("num", [85, 80, 50, 100])
def test_similar_sets_share_a_shingle_of_their_prefixes(num):
    r = np.random.default_rng(5)
    tried = 0
    for n in [1, 2, 3, 5, 6, 7, 9, 12, 13, 20, 28, 29, 40, 63, 94, 141, 300, 700]:
        for _ in range(60):
            u = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            drop, add = (r.integers(0, max(1, n * (100 - num) // 100) + 1) for _ in range(2))
            v = np.unique(np.concatenate([r.permutation(u)[drop:], r.integers(0, 1 << 63, add, dtype=np.uint64)]))
            both = np.intersect1d(u, v)
            if len(both) * 100 >= num * (len(u) + len(v) - len(both)) and len(v):
                tried += 1
                # some shingles are held by others as well, and all of these come back to both sets
                often = {x: int(r.integers(2, 6)) for x in both.tolist()} | {x: 9 for x in np.setxor1d(u, v).tolist() if r.random() < 0.3}
                firsts = []
                for s in (u, v):
                    back = np.array(sorted((x for x in s.tolist() if x in often), key=lambda x: (often[x], x)), np.uint64)
                    first = jaccard.prefixes(np.zeros(len(back), np.int64), np.full(len(back), len(s)), back, np.array([often[x] for x in back.tolist()]), num, 100)
                    firsts.append(back[first])
                assert len(np.intersect1d(*firsts))
    assert tried > 100


def test_packed_arrays_come_back():
    r = np.random.default_rng(3)
    given = [np.sort(r.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)), r.integers(-9, 9, 40), np.zeros(0, np.int32), np.array([2**31 - 1], np.int32), np.zeros(0, np.uint64), np.arange(7, dtype=np.uint16)]
    for a, b in zip(given, packing.unpacked(packing.packed(*given)), strict=True):
        assert a.dtype == b.dtype
        assert a.tolist() == b.tolist()


def test_blocks_of_sets_come_back():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) % np.uint64(500)) for n in (0, 5, 0, 90, 1, 300, 0)]
    name, size, got = jaccard._sets_of(jaccard._block(np.arange(7), np.arange(7) + 400, sets))
    assert (name.tolist(), size.tolist()) == (list(range(7)), list(range(400, 407)))
    assert [s.tolist() for s in got] == [s.tolist() for s in sets]


def test_forest():
    r = np.random.default_rng(6)
    u, v = r.integers(-400, 400, 300), r.integers(-400, 400, 300)
    u, v = np.concatenate([u, np.arange(1000, 1900)]), np.concatenate([v, np.arange(1001, 1901)])
    root = {}
    for x in [*u.tolist(), *v.tolist()]:
        root[x] = x
    for _ in root:
        before = dict(root)
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    a, b = jaccard.forest(u, v)
    assert dict(zip(b.tolist(), a.tolist(), strict=True)) == {x: y for x, y in root.items() if x != y}


def test_product_equals_brute_force():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(r.permutation(base)[: r.integers(300, 400)]) for _ in range(40)] + [np.unique(r.integers(0, 99, 5, dtype=np.uint64))]
    link, cross = jaccard.product(sets, 80, 100), jaccard.product(sets[:15], 80, 100, None, sets[10:])
    for a in range(41):
        for b in range(41):
            both = len(np.intersect1d(sets[a], sets[b]))
            near = both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both)
            assert link[a, b] == (a != b and near)
            if a < 15 and b >= 10:
                assert cross[a, b - 10] == near


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    edges += [(1000, 1000 + i) for i in range(1, 50)]
    top = {x: x for e in edges if None not in e for x in e}
    for _ in top:
        for a, b in (e for e in edges if None not in e):
            top[a] = top[b] = min(top[a], top[b])
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == top
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("width", "num", "block", "hot", "chunk"), [(4, 85, 256, 32, 1 << 23), (5, 80, 256, 4, 1 << 14), (4, 85, 8, 32, 1 << 12), (5, 80, 4, 3, 1 << 13)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, width, num, block, hot, chunk):
    for name, value in (("BROADCAST_BYTES", 0 if block == 8 else 1 << 20), ("BLOCK_SETS", block), ("TILE_SETS", 2 * block), ("HOT", hot), ("CHUNK_BYTES", chunk)):
        monkeypatch.setattr(jaccard, name, value)
    rows, n = awkward(), 100
    passage = prose("common", 60)
    for seed, (count, words, share) in enumerate([(12, 80, 0.02), (30, 40, 0.03), (60, 150, 0.015), (6, 8, 0.1), (9, 5, 0.2)]):
        for t in family(seed, count, words, share):
            rows.append((n, t, "f"))
            n += 1
    for i in range(20):
        rows.append((n + i, prose(f"p{i}", 30) + " " + passage + " " + prose(f"q{i}", 30), "p"))
    rows += [(n + 40 + i, rows[20][1].upper() + " ", "copy") for i in range(15)] + [(8, rows[30][1], "second text"), (3, "a b", "second")]
    random.Random(1).shuffle(rows)
    want = linked_components(rows, width, num, 100)
    got = jaccard.join(documents(spark, rows), width, num).collect()
    assert len(got) == len(rows)
    sizes = Counter((i, len(shingle_set(t, width))) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]] if r["n_shingles"] or r["doc_id"] == 3 else r["doc_id"]), r
    assert jaccard.join(documents(spark, [])).count() == 0


def best_window(words, item, width):
    w = min(width, len(item))
    bag = Counter(tuple(item[i : i + w]) for i in range(len(item) - w + 1))
    best = 0
    size = min(len(item), len(words))
    for at in range(len(words) - size + 1):
        part = words[at : at + size]
        got = Counter(tuple(part[i : i + w]) for i in range(len(part) - w + 1))
        best = max(best, sum((bag & got).values()) / max(1, sum((bag | got).values())))
    return best


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    items = [(i, prose(f"item{i}", 12 + 3 * i)) for i in range(12)] + [(50, "short item"), (51, ""), (52, None), (53, "one two three four five"), (1, prose("item1", 15)), (54, "ha " * 30)]
    rows = awkward()
    for i, (_, text) in enumerate(items[:12]):
        rows += [(100 + i, prose(f"x{i}", 40) + "\n" + text.translate(UPPER).replace(" ", ", ") + " " + prose(f"y{i}", 60), "in")]
        rows += [(200 + i, prose(f"z{i}", 20) + " " + edited(text, r, 0.04) + " " + prose(f"w{i}", 20), "near")]
        rows += [(300 + i, " ".join(text.split()[2:]), "cut"), (400 + i, " ".join(text.split()[: len(text.split()) // 2]) + " " + prose(f"v{i}", 50), "half")]
    rows += [(500, "it has a short item inside", "s"), (501, "one two three four five", "s"), (502, "ha " * 100, "s"), (503, "ha " * 20, "s")]
    df, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    want = {}
    for i, text, _ in rows:
        for k, item in items:
            if plain_words(item, pattern) and (s := best_window(plain_words(text, pattern), plain_words(item, pattern), 5)) >= 0.8:
                want[i, k] = s
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.find(df, bench).collect()}
    assert got == pytest.approx(want)
    assert all((100 + i, i) in got for i in range(12))
    clean = decontamination.keep_clean(df, bench)
    assert clean.columns == df.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, _, _ in rows if i not in {a for a, _ in want})
    assert decontamination.find(df, bench.limit(0)).count() == 0 == decontamination.find(df.limit(0), bench).count()


def test_decontamination_in_lots(spark, monkeypatch):
    items = [(i, prose(f"item{i}", 20)) for i in range(30)]
    df, bench = documents(spark, [(i, prose("a", 9) + " " + t, "s") for i, t in items]), spark.createDataFrame(items, "item_id long, text string")
    for name, most in (("LOT_BYTES", 600), ("LOT_ITEMS", 9)):
        with monkeypatch.context() as patched:
            patched.setattr(decontamination, name, most)
            assert {(r["doc_id"], r["item_id"]) for r in decontamination.find(df, bench).collect()} == {(i, i) for i, _ in items}
            clean = df.unionByName(documents(spark, [(99, prose("clean", 40), "s")]))
            assert [r["doc_id"] for r in decontamination.keep_clean(clean, bench).collect()] == [99]


def test_the_index_of_a_full_lot_is_bounded():
    items = [(i, prose(f"lot{i}", 12)) for i in range(decontamination.LOT_ITEMS)]
    index = decontamination.Index(items)
    held = sum(v.nbytes + w.nbytes for _, _, sizes in index.widths.values() for _, near in sizes.values() for v, w in near.tables)
    assert held < 100 << 20


def test_fingerprints_of_edited_texts(spark):
    rows = awkward() + [(20 + i, prose(i, 40 + 30 * i), "m") for i in range(25)] + [(60, "abc", "s"), (61, "one two three", "s"), (62, prose(1, 9000), "again")]
    got = fingerprints.compare_edited(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    # the two rows of doc_id 5 are the same, so their order does not matter
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    prints = {}
    for k, (i, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        r = by_id[i].pop() if i != 5 else next(x for x in by_id[5] if x["edited_sha256"] == sha(changed))
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(changed)), i
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(changed, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1
        assert 0 <= r["near_next"] <= 1
        if text == after:
            assert r["near_next"] == 1
        if text == changed:
            assert r["near_edited"] == 1
        if len(text) > 600 and i not in (6, 7, 9, 62):
            assert r["near_edited"] > 0.35
            assert text == after or r["near_next"] < 0.2
    assert fingerprints.compare_edited(documents(spark, [])).count() == 0
    assert fingerprints.compare_edited(documents(spark, [(4, "alone in the table", "s")])).first()["near_next"] == 1


def test_windows_are_found_through_the_index():
    r = np.random.default_rng(8)
    prints = r.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    flips = [np.bitwise_or.reduce(np.uint64(1) << r.permutation(64)[:k].astype(np.uint64)) for k in r.integers(1, decontamination.RADIUS + 1, 200)]
    got = np.concatenate([prints ^ np.array(flips), r.integers(0, 1 << 63, 2000, dtype=np.uint64)])
    place, item = decontamination.Neighbours(prints).candidates(got)
    pairs = set(zip(place.tolist(), item.tolist(), strict=True))
    assert len(pairs) == len(place)
    near = np.bitwise_count(got[:, None] ^ prints[None, :]) <= decontamination.RADIUS
    assert {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True)} <= pairs
    assert len(pairs) < 0.2 * len(got) * len(prints)


def test_recall_of_the_radius():
    r = np.random.default_rng(1)
    apart = []
    for n in (16, 30, 60, 120, 200):
        for _ in range(800):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a.copy()
            b[r.integers(0, n, r.integers(1, 3 + n // 20))] = r.integers(0, 1 << 63, dtype=np.uint64)
            x, y = bytewords.chained(a, 5), bytewords.chained(b, 5)
            if decontamination.weighted_jaccard(Counter(x.tolist()), Counter(y.tolist())) >= 0.8:
                apart.append(np.bitwise_count(decontamination.fingerprints(x, len(x)) ^ decontamination.fingerprints(y, len(y)))[0])
    assert len(apart) > 300
    assert np.mean(np.array(apart) <= decontamination.RADIUS) > 0.995


def test_decontamination_of_a_long_text_and_many_items(spark):
    items = [(i, prose(f"many{i}", 20)) for i in range(300)]
    long_ = " ".join(t for _, t in items) + " " + prose("tail", 15000)
    df, bench = documents(spark, [(1, long_, "s"), (2, prose("clean", 3000), "s")]), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, i) for i, _ in items}
    assert all(r["similarity"] == 1 and r["bits_apart"] == 0 and r["first_word"] == 20 * r["item_id"] for r in got)


def pair_likeness(spark, pairs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    prints = df.select("i", fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    return [r for r in prints.select("i", "a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]


def test_likeness_of_short_texts_and_across_all_lengths(spark):
    long_, other = prose(4, 200), prose(5, 200)
    cases = [(long_[:311], long_[:233] + "no."), (long_[:250], long_[:250] + " and so on."), (long_[:505], long_[:505] + " and so on"), ("one two three four", "one two three five"), ("x" * 40 + "日本語のテキスト" * 30, "x" * 40 + "日本語のテキスト" * 30 + "終")]
    cases += [(long_[:n], long_[: n - n // 10]) for n in range(60, 700, 40)]
    assert all(r["x"] > 0.3 for r in pair_likeness(spark, cases))
    assert all(r["x"] < 0.1 for r in pair_likeness(spark, [(long_[:n], other[:n]) for n in range(100, 900, 50)]))
    same = [("", None), ("one", "one"), (long_, long_), ("", "")]
    assert all(r["x"] == 1 for r in pair_likeness(spark, same))


def test_likeness_equals_brute_force_and_uses_places(spark):
    words_ = prose(6, 900).split()
    blocks = [words_[i : i + 90] for i in range(0, 900, 90)]
    shuffled = [w for k in (7, 2, 9, 0, 5, 3, 8, 1, 6, 4) for w in blocks[k]]
    r = random.Random(2)
    cases = [(" ".join(words_), " ".join(shuffled)), (" ".join(words_), "in front " * 20 + " ".join(words_)), (" ".join(words_), edited(" ".join(words_), r, 0.03)), (prose(7, 30), edited(prose(7, 30), r, 0.05)), (prose(9, 4000), edited(prose(9, 4000), r, 0.01))]
    got = pair_likeness(spark, cases)

    def alike(a, b):
        places, others = (dict(zip(x["hashes"], x["places"], strict=True)) for x in (a, b))
        every = sorted({*places, *others})[: max(64, min(len(places), len(others)))]
        moved = sorted(others[h] - places[h] for h in every if h in places and h in others)
        reach = max(16, max([*places.values(), *others.values()]) // 8)
        return sum(abs(m - moved[len(moved) // 2]) <= reach for m in moved) / len(every) if moved else 0.0

    for x in got:
        both_fine = x["a"]["fine"]["hashes"] and x["b"]["fine"]["hashes"]
        assert x["x"] == pytest.approx(max(alike(x["a"]["words"], x["b"]["words"]), alike(x["a"]["fine"], x["b"]["fine"]) if both_fine else 0))
    assert len(got[4]["a"]["words"]["hashes"]) > 100  # grows with the text
    assert got[1]["x"] > 0.8
    assert got[0]["x"] < 0.6  # the same passages in another order


def test_next_documents_where_one_id_holds_a_third_of_all_rows(spark):
    ids = [*range(60), *[7] * 40, None, -(1 << 63)]
    rows = [(i, f"{k:04d} " + prose(k, 6), "s") for k, i in enumerate(ids)]
    got = fingerprints.compare_edited(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    known = {sha(t[: len(t) - len(t) // 4] + u[: len(t) // 4]): (t, u) for _, t, _ in rows for _, u, _ in rows}
    after = dict(known[r["edited_sha256"]] for r in got)  # a cycle through all texts, ids in order
    at, seen = rows[0][1], []
    for _ in rows:
        seen.append(at)
        at = after[at]
    assert at == rows[0][1]
    assert len(set(seen)) == len(rows)
    by_text = {t: i for i, t, _ in rows}
    order = [by_text[t] for t in seen]
    assert order[: -2] == sorted(order[:-2])
    assert set(order[-2:]) == {None, -(1 << 63)}


def test_anchors_equal_brute_force(spark):
    text = prose(8, 400)
    df = documents(spark, [(1, text, "a"), (2, "z " * 3 + text[:700], "a")])
    got = {r["doc_id"]: r for r in df.select("doc_id", fingerprints.anchors(df["text"]).alias("a"), __import__("pyspark.sql.functions", fromlist=["x"]).expr("transform(split(text, ' '), u -> xxhash64(u))").alias("h")).collect()}
    from pyspark.sql import functions as F

    h = got[1]["h"]
    inner = [r["x"] for r in spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(len(h) - 1)], "i int, a long, b long").orderBy("i").select(F.xxhash64("a", "b").alias("x")).collect()]
    want = [i for i in range(len(h) - 4) if min(inner[i : i + 4]) in (inner[i], inner[i + 3])]
    assert [a["place"] for a in got[1]["a"]] == want
    # the same passage has the same anchors at another place
    moved = {a["hash"]: a["place"] for a in got[2]["a"]}
    shared = [moved[a["hash"]] - a["place"] for a in got[1]["a"] if a["hash"] in moved]
    assert len(shared) > 20
    assert set(shared) == {3}
