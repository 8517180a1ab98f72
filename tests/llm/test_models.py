import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import language_model, toxicity
from tests.llm.cases import awkward, documents, prose

LOWER = {c: c + 32 for c in range(65, 91)}
DATA = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    toxic = [r["score"] for y, r in held if y]
    clean = [r["score"] for y, r in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
    right = np.mean([(r["predicted"] == 1) == bool(y) for y, r in held])
    assert right > 0.9


def test_toxicity_of_awkward_tables(spark):
    rows = awkward() + [(100 + i, prose(i, 40) + (" vile scum" if i % 3 == 0 else ""), "a") for i in range(120)]
    df = documents(spark, rows)
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0), "x") for i in range(120)] + [(None, 1, "x"), (1, None, "x"), (100, 1, "x"), (999, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score(df, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["score"] == by[3]["score"] == by[10]["score"]
    assert not by[None]["held_out"]
    assert np.mean([by[100 + i]["predicted"] == (i % 3 == 0) for i in range(120)]) > 0.95
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["score"] < 0.3)
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert len({r["score"] for r in toxicity.score(df, none).collect()}) == 1
    assert toxicity.score(df.limit(0), labels).count() == 0


def ngrams(text, order):
    text = (text or "").translate(LOWER)
    return [text[i : i + order] for i in range(len(text) - order + 1)]


def bucket(gram):
    return int(toxicity._buckets(np.frombuffer(gram.encode("utf-32-le"), np.uint32), len(gram))[0])


def test_toxicity_features_and_scores_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 150)
    texts = [prose(i, 25) + (" vile scum Ünd" if i % 3 == 0 else " kind friend") for i in range(40)] + ["", "no", "vile"]
    labels = [int(i % 3 == 0) for i in range(40)] + [0, 0, 1]
    shares = (0.8, 0.2)
    model = toxicity.fit(texts, labels, shares)
    often = [Counter(bucket(g) for order in toxicity.ORDERS for g in ngrams(t, order)) for t in texts]
    held = [Counter(b for c, y in zip(often, labels, strict=True) if y == label for b in c) for label in (0, 1)]
    n = [labels.count(0), labels.count(1)]
    p = [{b: (held[y][b] + 1) / (n[y] + 2) for b in held[0] | held[1]} for y in (0, 1)]
    ratio = {b: np.log(p[1][b] / p[0][b]) for b in p[0]}
    weigh = {b: abs(p[1][b] - p[0][b]) / np.sqrt(sum(p[y][b] * (1 - p[y][b]) / n[y] for y in (0, 1))) for b in ratio if held[0][b] + held[1][b] >= 3}
    best = sorted(weigh.values(), reverse=True)[:150]
    assert len(model.features) == 150
    assert all(weigh[b] >= best[-1] - 1e-12 for b in model.features.tolist())
    # no neighbouring weights make the weighted loss smaller
    x = np.array([[ratio[b] * np.log2(1 + c[b]) for b in model.features.tolist()] for c in often])
    w = model.weights / np.array([ratio[b] for b in model.features.tolist()])
    y, weight = np.array(labels), np.array([shares[k] / n[k] for k in labels])
    assert model.bias == pytest.approx(np.log(0.2 / 0.8))
    gradient = x.T @ (weight * (1 / (1 + np.exp(-(x @ w + model.bias))) - y)) + toxicity.L2 * w
    start = x.T @ (weight * (0.2 - y))
    assert np.abs(gradient).max() < 0.02 * np.abs(start).max()
    want = [1 / (1 + np.exp(-(model.bias + sum(v * np.log2(1 + c[b]) for b, v in zip(model.features.tolist(), model.weights.tolist(), strict=True))))) for c in often]
    assert model.score(pa.array(texts, pa.string())) == pytest.approx(want)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, shares: seen.append((texts, labels)) or toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0))
    rows = [(i, prose(i, 30), "s") for i in range(400)] + [(5, prose(f"again{k}", 30), "s") for k in range(50)] + [(6, prose(6, 30), "s")] * 20
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic")
    toxicity.train(documents(spark, rows), labels, a_label=40)
    texts, y = seen[-1]
    assert Counter(y) == {0: 40, 1: 40}
    assert len(set(texts)) == 80
    toxicity.train(documents(spark, rows), labels, a_label=40, most_bytes=4000)
    assert 3000 < sum(len(t.encode()) for t in seen[-1][0]) <= 4000
    assert 0 < sum(seen[-1][1]) < len(seen[-1][1])


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), "\0end"]


def test_language_model_counts_equal_brute_force(spark):
    rows = awkward() + [(100 + i, " ".join(prose(j % 9, 12) for j in range(i % 13)), "m") for i in range(150)]
    got = language_model.score(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text, _ in rows if i is not None and not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t, _ in rows)
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    for a, b in zip(found, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-4)
    assert all(r["score"] < 0 for r in got)
    assert language_model.score(documents(spark, [])).count() == 0


def every_symbol(model, before, v):
    """Log-probabilities of all symbols after the symbols ``before``."""
    texts = [np.array([*before, k], np.int32) for k in range(v)]
    logs = model.log_probabilities(np.concatenate(texts), np.full(v, len(before) + 1))
    return logs[len(before) :: len(before) + 1]


def test_language_model_is_normalised_and_learns():
    r = np.random.default_rng(1)
    chain = [0]
    for _ in range(40_000):
        chain.append((chain[-1] * 7 + 3) % 50 if r.random() < 0.8 else int(r.integers(0, 50)))
    symbols, sizes = np.array(chain, np.int32), np.array([len(chain)])
    counts = np.bincount(symbols, minlength=language_model.OUTPUTS)
    model = language_model.Model(counts)
    before = model.log_probabilities(symbols[:2000], np.array([2000])).mean()
    trainer = language_model.Trainer(model)
    for _ in range(4):
        trainer.learn(symbols, sizes)
    assert trainer.seen == 4 * len(symbols)
    after = model.log_probabilities(symbols[:2000], np.array([2000])).mean()
    assert after > before + 1
    for given in ([], [3], [5, 2, 7, 9, 1]):
        assert np.exp(every_symbol(model, given, language_model.OUTPUTS)).sum() == pytest.approx(1, abs=1e-4)


def test_a_step_equals_plain_loops():
    """One step of noise-contrastive estimation, gradients by plain loops."""
    r = np.random.default_rng(4)
    counts = r.integers(1, 90, language_model.OUTPUTS + 20)
    model, plain = language_model.Model(counts), language_model.Model(counts)
    sizes = np.array([5, 1, 9])
    symbols = r.integers(0, len(counts), sizes.sum()).astype(np.int32)
    language_model.Trainer(model).learn(symbols, sizes)
    trainer = language_model.Trainer(plain)
    assert plain.width <= language_model.DRAWN
    w = [x.astype(float) for x in plain.weights()]
    squares = [np.full(x.shape, 1e-2) for x in w]
    contexts, at = [], 0
    for size in sizes:
        ranks = [plain.start] * 4 + plain.rank[symbols[at : at + size]].tolist()
        at += size
        contexts += [(ranks[i - 4 : i][::-1], *divmod(ranks[i], plain.width)) for i in range(4, len(ranks))]
    qs, to_q = [sum(w[1][k] * w[0][before[k]] for k in range(4)) for before, _, _ in contexts], np.zeros((len(contexts), language_model.SIZE))

    def moved(which, gradient):
        squares[which] += gradient**2
        w[which] += language_model.RATE * gradient / np.sqrt(squares[which])

    # classes, then the tokens, then the noise of their classes
    for table, bias, part in ((4, 5, "classes"), (2, 3, "targets"), (2, 3, "noise")):
        of_table, of_bias = np.zeros(w[table].shape), np.zeros(w[bias].shape)
        for i, (_, g, inside) in enumerate(contexts):
            places = [(j,) for j in range(len(w[4]))] if part == "classes" else [(g, inside)] if part == "targets" else [(g, j) for j in range(plain.width)]
            for place in places:
                noise = trainer.class_noise[place] if part == "classes" else trainer.noise[place]
                seems = 1 / (1 + np.exp(-(w[table][place] @ qs[i] + w[bias][place] - (np.log(noise) if noise else 0))))
                push = -noise * seems if part == "noise" else 1 - seems if part == "targets" else (1 - seems if place == (g,) else 0) - noise * seems
                of_table[place] += push * qs[i] / len(contexts)
                of_bias[place] += push / len(contexts)
                to_q[i] += push * w[table][place]
        moved(table, of_table)
        moved(bias, of_bias)
    inputs, position = np.zeros(w[0].shape), np.zeros(w[1].shape)
    for i, (before, _, _) in enumerate(contexts):
        for k in range(4):
            inputs[before[k]] += w[1][k] * to_q[i] / len(contexts)
            position[k] += w[0][before[k]] * to_q[i] / len(contexts)
    moved(0, inputs)
    moved(1, position)
    for got, want in zip(model.weights(), w, strict=True):
        assert got == pytest.approx(want, abs=1e-4)


def test_scores_equal_plain_loops_and_do_not_depend_on_partitions(spark, monkeypatch):
    rows = [r for r in awkward() if r[0] not in (6, 7)] + [(100 + i, " ".join(prose(j % 9, 12) for j in range(i % 13)), "m") for i in range(80)]
    given, kept = [], language_model._scored
    monkeypatch.setattr(language_model, "_scored", lambda *x: given.append(x) or kept(*x))
    monkeypatch.setattr(language_model, "LOT_TOKENS", 1500)
    df = documents(spark, rows)
    got = [sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["score"]) for r in language_model.score(df.repartition(n)).collect()) for n in (2, 9)]
    assert [r[2] for r in got[0]] == pytest.approx([r[2] for r in got[1]], abs=1e-3)

    vocabulary = given[0][0].value
    symbol_counts, n_by, v_by = vocabulary.symbol_counts, vocabulary.n_by, vocabulary.v_by
    model = language_model.Model(symbol_counts).load(given[0][1].value)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text, _ in rows if i is not None and not held(i) for t in tokens(text)[:-1])
    total = sum(len(tokens(t)) for i, t, _ in rows if i is not None and not held(i))
    # of equal counts at the border, those of the smaller hash are symbols
    hashes = dict(zip(counts, language_model.words(pa.array(list(counts)))[0].view(np.int64).tolist(), strict=True))
    own = sum(c >= language_model.least_count(total) for c in counts.values())
    ordered = sorted(counts, key=lambda w: (-counts[w], hashes[w]))[: max(language_model.LEAST_WORDS, own)]
    assert len(symbol_counts) == language_model.OUTPUTS + len(ordered)
    number = {w: language_model.OUTPUTS + k for k, w in enumerate(ordered)} | {"\0end": language_model.END}

    def symbol(word):
        if word in number:
            return number[word]
        raw = word.encode()
        return int(language_model._rare(np.array([raw[-1] * 256 + (raw[-2] if len(raw) > 1 else 0)]))[0])

    def softmax(table, bias, q, at):
        logits = table.astype(float) @ q + bias
        return logits[at] - np.log(np.exp(logits).sum())

    want = []
    for i, text, _ in rows:
        before, total = [model.start] * 4, 0.0
        for word in tokens(text):
            s = symbol(word)
            q = sum(model.position[k].astype(float) * model.inputs[before[-1 - k]] for k in range(4))
            g, inside = divmod(int(model.rank[s]), model.width)
            total += (softmax(model.classes, model.class_bias, q, g) + softmax(model.outputs[g], model.bias[g], q, inside)) / np.log(10)
            if s < language_model.RARE:
                left = [w for w in counts if w not in number and symbol(w) == s]
                assert (n_by[s], v_by[s]) == (sum(counts[w] for w in left), len(left))
                total += log10((counts[word] + 1) / (n_by[s] + v_by[s] + 1))
            before.append(int(model.rank[s]))
        want.append((-1 if i is None else i, len(tokens(text)), total))
    for a, b in zip(got[0], sorted(want), strict=True):
        assert a[:2] == b[:2]
        assert a[2] == pytest.approx(b[2], abs=1e-2, rel=1e-4)


def test_every_token_of_learnable_texts_is_learned_from(monkeypatch):
    monkeypatch.setattr(language_model, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    texts = ["one two three", None, "held out text", "four"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts, "learn": [True, True, False, True], "held_out": [False, False, True, False]})
    rows = pa.Table.from_batches(language_model._written(4, 1 << 20)(iter([batch])))
    counted = [language_model.unpacked(x) for x in rows.filter(pa.array(rows["kind"].to_numpy() == language_model._WORDS))["payload"].to_pylist()]
    assert sum(int(p[1].sum()) for p in counted) == 4 + 1 + 2
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    given = type("B", (), {"value": language_model.Vocabulary(*none, np.ones((2, language_model.OUTPUTS), np.int64))})()
    chunks = rows.filter(pa.array(rows["kind"].to_numpy() == language_model._CHUNK)).select(["ids", "learn", "sizes", "payload"])
    dealt = pa.Table.from_batches(language_model._dealt(given, 3)(iter(chunks.to_batches())))
    learned = [language_model.unpacked(x) for x in dealt["payload"].to_pylist()]
    assert sum(len(p[2]) for p in learned) == 4 + 1 + 2
    assert sorted(n for p in learned for n in p[1].tolist()) == [1, 2, 4]
    assert language_model._trained(given)(dealt.slice(0, 1))["weight"][0].as_py() == len(learned[0][2])


def test_symbols_grow_with_the_corpus_and_all_are_learned(spark, monkeypatch):
    made = []
    kept = language_model._trained
    monkeypatch.setattr(language_model, "_trained", lambda given: made.append(given.value) or kept(given))
    for n in (300, 900):
        # all words are as frequent as any other
        rows = [(i, " ".join(f"a{j} b{j}" for j in np.random.default_rng(i).permutation(n)), "m") for i in range(60)]
        got = language_model.score(documents(spark, rows)).collect()
        assert len(made[-1].hashes) == 2 * n
        assert sorted(made[-1].symbols.tolist()) == list(range(language_model.OUTPUTS, language_model.OUTPUTS + 2 * n))
        assert all(r["score"] < 0 for r in got)


def test_words_are_counted_exactly_however_many_a_batch_holds():
    # 3000 words stand before one that each chunk holds once; both chunks get the sums back
    text = " ".join(f"w{i} w{i}" for i in range(3000)) + " zz"
    tokens_, tails, _ = language_model._tokens(pa.array([text]))
    uniq, first, count = np.unique(tokens_, return_index=True, return_counts=True)
    piece = language_model.packed(uniq, count.astype(np.int32), language_model._rare(tails[first]).astype(np.uint8))
    got = language_model._summed(pa.table({"chunk": [1, 2], "low": [0, 0], "payload": pa.array([piece] * 2, pa.binary())})).to_pylist()
    for r in got[:2]:
        assert sorted(language_model.unpacked(r["payload"])[0].tolist()) == [2, 2] + [4] * 3000
    sums = language_model.unpacked(got[2]["payload"])[0].reshape(2, -1)
    assert sums.sum(1).tolist() == [2 * 6002, 3002]
    assert len(language_model.unpacked(got[3]["payload"])[0]) >= 3000


def test_word_beyond_the_old_cap_is_predicted_from_its_context():
    v = language_model.OUTPUTS + 600
    firsts = language_model.OUTPUTS + 2 * np.random.default_rng(2).integers(0, 300, 30_000)
    symbols = np.column_stack([firsts, firsts + 1]).ravel().astype(np.int32)  # each even symbol is followed by the next
    whole = np.array([len(symbols)])
    model = language_model.Model(np.bincount(symbols, minlength=v))
    odd = np.flatnonzero(symbols >= language_model.OUTPUTS + 192)
    odd = odd[odd % 2 == 1]
    before = model.log_probabilities(symbols, whole)[odd].mean()
    trainer = language_model.Trainer(model)
    for _ in range(6):
        trainer.learn(symbols, whole)
    assert model.log_probabilities(symbols, whole)[odd].mean() > before + 0.5
    assert np.exp(every_symbol(model, symbols[:7].tolist(), v)).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_stay_inside_a_text():
    every, place = language_model.laid_out(np.array([5, 6, 7, 8]), np.array([3, 1]), 99)
    assert every.tolist() == [99] * 4 + [5, 6, 7] + [99] * 4 + [8]
    assert every[place].tolist() == [5, 6, 7, 8]


def test_language_model_beats_the_base_on_held_out_texts(spark):
    got = language_model.score(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
