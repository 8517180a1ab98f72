import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from gridloom.llm import chat, licenses, mixing, token_counts, urls
from tests.llm.cases import awkward, documents, prose, sha

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base_scan(text):
    words = SPLIT.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for p, label in licenses.BASE_PHRASES.items():
        q = p.split()
        for i in range(len(words) - len(q) + 1):
            if words[i : i + len(q)] == q:
                places.append(i)
                labels.add(label)
    return words, sorted(places), labels


def matches(words, templates):
    """{label: containment} of the templates that some block matches, unless a rival matches better there and the block without one notice of it falls short."""
    threshold = licenses.THRESHOLD
    size = lambda t: licenses.class_of(len(t.split()))
    near = lambda a, b: a != b and size(a) == size(b) and len(set(a.split()) & set(b.split())) >= threshold * min(len(set(a.split())), len(set(b.split())))
    out = {}
    for t, label in templates.items():
        c = size(t)
        for i in range(0, max(len(words), 1), c):
            block = set(words[i : i + 2 * c])
            share = lambda x: (len(set(x.split()) & block) / len(set(x.split())), len(set(x.split())))  # noqa: B023, E731
            left = lambda o: Counter(words[i : i + 2 * c]) - Counter(set(o.split()))  # noqa: B023, E731
            falls = lambda o: len(set(t.split()) & set(left(o))) < threshold * len(set(t.split()))  # noqa: B023, E731
            if share(t)[0] >= threshold and not any(near(t, o) and share(o) > share(t) and falls(o) for o in templates):
                out[label] = max(out.get(label, 0), share(t)[0])
    return out


def test_license_scan_equals_brute_force(spark):
    extra = [(20 + i, prose(i, 30) + " " + t.upper() + ". " + prose(i + 50, 30), "z") for i, t in enumerate(licenses.TEMPLATES)]
    extra += [(60, "gnu general public license gnu general public license mit licenses apache\nlicense", "z")]
    extra += [(61, "licensed under the apache pear version 2 0", "z"), (62, "licensed the apache version", "z")]
    # the Kelvin sign is no k, and words with other letters beyond ASCII are not folded
    extra += [(63, "This wor\u212a is licensed under a Creative Commons Attribution 4.0 International License", "z"), (64, "MIT LİCENSE É é", "z"), (65, "\u212a k", "z")]
    # two whole notices that are rivals: in one block, either way round, and apart
    notices = {label: t for t, label in licenses.TEMPLATES.items() if label in ("gpl-any", "lgpl-any", "cc-by-4.0", "cc-by-sa-4.0")}
    for k, (a, b, gap) in enumerate([("gpl-any", "lgpl-any", 0), ("lgpl-any", "gpl-any", 0), ("cc-by-4.0", "cc-by-sa-4.0", 0), ("cc-by-sa-4.0", "cc-by-4.0", 3), ("gpl-any", "lgpl-any", 200)]):
        extra += [(80 + k, f"{notices[a]} {prose(k, gap)} {notices[b]}", "rivals")]
    rows, long_ = awkward() + extra, " ".join(f"clause{i}" for i in range(150))
    rows += [(66, prose("l", 70) + " " + long_ + " " + prose("m", 20), "z"), (67, " ".join(long_.split()[:110]), "z")]
    for templates in (licenses.TEMPLATES, {**licenses.TEMPLATES, long_: "long"}):
        got = defaultdict(list)
        for r in licenses.scan(documents(spark, rows), templates).collect():
            got[r["doc_id"]].append(r)
        assert sum(map(len, got.values())) == len(rows)
        for i, text, _ in rows:
            words, places, labels = base_scan(text)
            hit = matches(words, templates)
            for r in got[i]:
                assert (r["n_words"], r["n_base"]) == (len(words), len(places))
                assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))
                assert r["base_labels"] == ",".join(sorted(labels))
                assert r["labels"] == ",".join(sorted(labels | set(hit)))
                assert r["score"] == pytest.approx(max([*hit.values(), 1.0 if places else 0.0]))
    told = {label: next(r["labels"].split(",") for r in got[20 + i]) for i, label in enumerate(licenses.TEMPLATES.values())}
    assert "gpl-any" not in told["lgpl-any"]
    assert "cc-by-sa-4.0" not in told["cc-by-4.0"]
    assert "cc-by-4.0" not in told["cc-by-sa-4.0"]
    assert got[66][0]["labels"] == "long"
    assert [{"gpl-any", "lgpl-any"} <= set(got[k][0]["labels"].split(",")) for k in (80, 81, 84)] == [True] * 3
    assert [{"cc-by-4.0", "cc-by-sa-4.0"} <= set(got[k][0]["labels"].split(",")) for k in (82, 83)] == [True] * 2
    assert got[63][0]["score"] == pytest.approx(12 / 13)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "", None, "a<", "|b", "<\\|x <\\\\|", "é\n<|", "<|im_end|>\n<|im_end|>\n", "x" * 3000 + "<|"]
    roles = ["user", "assistant", "system", None, "odd\nrole\\n<|im_end|>"]
    rows = [(c, t, roles[(c + t) % 5], said[(c * 3 + t) % len(said)], 0) for c in range(12) for t in range(c + 1)]
    rows += [(3, 1, "assistant", "tie", 1), (3, 1, "assistant", "tie", 1), (None, 0, "assistant", "lost", 1), (90, None, "assistant", "no turn", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").repartition(4)
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((role or "", text or ""))
    formatted = chat.format_chats(df)
    got = {r["conv_id"]: r for r in formatted.collect()}
    assert {c: chat.parse(r["formatted"].encode()) for c, r in got.items()} == dict(want)
    for c, r in got.items():
        plain = b"".join(chat.START + chat._role(role) + b"\n" + chat.escape(text.encode()) + chat.END for role, text in want[c])
        assert r["formatted"].encode() == plain
    for r in chat.read_back(formatted).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def verdict(url, rules):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", tail)
    host, path = m[1].translate(LOWER), m[2]
    fits = lambda given: [r for r in given if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    best, own = max(fits(rules), key=lambda r: (len(r), r), default=None), max(fits(dict(urls.OWN_RULES)), key=len, default=None)
    return host, path, best, dict(rules)[best] if best else dict(urls.OWN_RULES)[own] if own else "allow"


def test_url_filter_equals_brute_force(spark, monkeypatch):
    seen = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://a.b.org/x?y#z", "https://example.org/en/174.html", "https://w.EXAMPLE.org/es/"]
    seen += ["http://borg/", "http://x.com/fr/1", "http://x.com/fr", "http://com/de/?q", "http://y.com/De/", "ftp://spam-farm.example.net/q", "http://a.casino-win.example.com/en/1", "http://spam-farm.example.com.net/", "http://spam-farm.example.org/fr/", "http://a://b.org/c", "http://example.org#/en/1"]
    seen += ["http://example.org/en/1", "http://example.org/en/1", "http://org/" + "p" * 20000, "http://" + "a." * 3000 + "org/", "http://x.org:80/"]
    seen += ["http://a.b.org/xyz", "http://w.cheap-pills.example.com/a"]
    rows = [(i, u, "kept", "old") for i, u in enumerate(seen)]
    df = spark.createDataFrame(rows, "page_id long, url string, Verdict string, html string")
    rules = dict(urls.BASE_RULES)
    for given in (tuple(rules.items()), (*rules.items(), ("example.org/", "block"), ("a.b.org/x", "block"), ("b.org/xy", "block"), ("cheap-pills.example.com/", "allow"))):
        got = urls.judge(df, rules=given)
        assert sorted(got.columns) == sorted(["page_id", "url", "html", "host", "path", "rule", "verdict"])
        for r in got.collect():
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(r["url"], dict(given)), r
    assert urls.judge(df).count() == len(rows)
    from gridloom.plans.compose import explained

    assert explained(urls.judge(df), "simple").count("SortMergeJoin") == 0
    want = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    assert {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()} == want
    assert urls.judge(df.limit(0)).count() == 0
    # columns named like working columns, or with odd names, pass through
    odd = df.selectExpr("*", "page_id as _short", "page_id as _host", "page_id as _path", "page_id as _best", "page_id as _digest0", "page_id as _listed0", "page_id as _in1", "page_id as `a.b`")
    for r in urls.judge(odd).collect():
        assert r["verdict"] == want[r["page_id"]]
        assert {r[c] for c in ("_short", "_host", "_path", "_best", "_digest0", "_listed0", "_in1", "a.b")} == {r["page_id"]}


def filled(sizes):
    total, open_ = Decimal(sum(s for _, s in sizes)), {k: Decimal((5, 2, 1)[i % 3]) for i, (k, _) in enumerate(sizes)}
    caps, done = {k: Decimal(3 * s) for k, s in sizes}, {}
    while open_:
        left = total - sum(done.values())
        share = {k: left * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in share if share[k] > caps[k]]
        if not over:
            return done | share
        for k in over:
            done[k] = caps[k]
            del open_[k]
    return done


def test_mixing(spark):
    rows = awkward() + [(100 + i, prose(i, 1 + i * 7 % 90), f"s{i % 7}") for i in range(400)] + [(600 + i, prose(i, 3), "tiny") for i in range(2)]
    df = documents(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    ordered = sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or ""))
    want = filled(ordered)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), abs=1e-5)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] >= int(r["target"] // max(1, r["source_size"])) * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= 1
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    rows = awkward() + [(30, "don't we'll I'd 'S it’s 12ab  34\n\n x\r\n", "a"), (31, "日本語 text ก्ม", "a"), (32, "a\x85b\xa0c\x1cd", "a"), (33, "<|endoftext|>" * 3, "a"), (34, "   lead  and trail   ", "b"), (35, "²³¼ ªº µ ×÷ …—“”", "b")]
    odd = ["日本", "😀", "\u3000", "\u200b", "ก็", "<|endoftext|>", "\x00", "\u00a0", "ʰ", "٣", "\u2028", "\u0301"]
    r = random.Random(3)
    for k in range(60):
        words_ = prose(f"odd{k}", 12).split(" ")
        for _ in range(r.randint(1, 5)):
            at = r.randrange(len(words_))
            words_[at] = r.choice([f"{words_[at]}{r.choice(odd)}", f"{r.choice(odd)}{words_[at]}", r.choice(odd), f"{r.choice(odd)} {r.choice(odd)}", f" {r.choice(odd)} ", "'s" + r.choice(odd)])
        rows.append((100 + k, r.choice([" ", "  ", "\n"]).join(words_), "odd"))
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(documents(spark, rows), path)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in rows)
    found = got.collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in found) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0


def test_only_the_stretch_around_an_odd_character_is_a_unit_of_its_own():
    import public_tokenizers

    worker = token_counts._worker(str(public_tokenizers.path("byte_bpe_50k.json")))
    # no place beside the odd characters is safe, the next spaces are
    assert worker.units("one two กขค three four") == ["one", " two กขค three", " four"]
    # scripts whose classes are old are cut like any other
    assert worker.units("one 日本語 שלום مرحبا 한국어 four") == ["one", " 日本語", " שלום", " مرحبا", " 한국어", " four"]
    for text in ("a b 日本 c d <|endoftext|> e f", "日本", "x 日 本 y", "", "no odd one", "a กข b ก c"):
        assert "".join(worker.units(text)) == text


def test_token_cache_stays_bounded_in_bytes():
    import sys

    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(8)
    texts = [prose(i, 200) for i in range(20)] + ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(20000)), " ".join("กขค" for _ in range(3000)), "x" * 9000]
    texts += ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(90)) + "。" for _ in range(300)]
    worker = token_counts._worker(path)
    worker.cache.clear()
    worker.held = 0
    free = token_counts.count_texts(texts, path, {})
    for most in (0, 500, 20_000):
        worker.cache.clear()
        worker.held = 0
        for low in range(0, len(texts), 7):
            assert token_counts.count_texts(texts[low : low + 7], path, {}, cache_bytes=most) == free[low : low + 7]
            assert sum(map(sys.getsizeof, worker.cache)) <= most
            assert max(map(len, worker.cache), default=0) <= token_counts._CACHED
    worker.cache.clear()
    worker.held = 0


def test_texts_of_many_scripts_pass_through_both_tiers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = str(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    letters = ["אבגדהוזחטי", "ابتثجحخدذر", "かきくけこ", "カキクケコ", "一二三人大日本語中", "가나다라마", "абвгд", "٠١٢٣", "、。！？（）", "12", "-–—", "é"]
    words_ = ["".join(r.choice(r.choice(letters)) for _ in range(r.randint(1, 5))) for _ in range(60)] + ["".join(r.choice(x) for _ in range(4)) for x in letters]
    rows = [(i, r.choice([" ", "  ", "\n", ""]).join(r.choice(words_) for _ in range(r.randint(1, 60))), "a") for i in range(120)]
    library = Tokenizer.from_file(path)
    want = sorted((i, len(library.encode(t, add_special_tokens=False))) for i, t, _ in rows)
    assert sorted((x["doc_id"], x["n_tokens"]) for x in token_counts.count_tokens(documents(spark, rows), path).collect()) == want
    worker = token_counts._worker(path)
    spoken = [u for _, t, _ in rows for u in worker.units(t)]
    table = token_counts.frequent_table(documents(spark, rows), path)
    assert sum(u in table for u in spoken) > 0.95 * len(spoken)
