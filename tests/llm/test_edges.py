"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluxledger.llm import chat_format, decontaminate, exact_dedup, langid, mixing, ngram_join, quality, suffix_dedup, url_filter, warc
from fluxledger.llm.common import components

DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base, None, None), (3, base, "en", "a"), (4, None, "en", "b"), (5, "", "de", "b"), (6, "  \n", None, "b"), (7, LONG, "de", None), (8, "two words", "de", "c"), (None, base + " end", "en", "c")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs.withColumns({"digest": F.lit(1), "id": F.lit(2)})).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["id"] in (1, 2, 3, 4, 5)) == [(1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (3, 3, 4, True), (4, 5, 2, False), (5, 5, 2, True)]
    assert len(rows) == 10 and exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_checks_bytes(docs):
    """A digest that maps everything to one key still gives right classes."""
    rows = exact_dedup.exact_dedup(docs, digest=lambda c: F.lit("x").cast("binary") if c is not None else c).collect()
    assert sorted((r["id"], r["keep_id"]) for r in rows if r["id"] is not None) == [(1, 3), (2, 3), (3, 3), (3, 3), (4, 5), (5, 5), (6, 6), (7, 7), (8, 8)]


def test_exact_dedup_goes_on(spark, tmp_path):
    def judged(rows):
        out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), checkpoint=f"file://{tmp_path}/state")
        return sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect())

    assert judged([(1, "a"), (5, "b")]) == [(1, 1, 1, True), (5, 5, 1, True)]
    assert judged([(3, "A"), (4, "B"), (6, "c")]) == [(3, 3, 2, True), (4, 5, 2, False), (6, 6, 1, True)]


def test_ngram_join(docs, none):
    rows = sorted(((r["id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs.withColumn("n", F.lit(1))).collect()), key=repr)
    assert rows == sorted([(1, 78, 1), (2, 78, 1), (3, 78, 1), (3, 78, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 29_998, 7), (8, 1, 8), (0, 79, 1)], key=repr)
    assert ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_dense_group(spark, k, percent):
    """Edited copies of one text: many pairs on both sides of the threshold."""
    rnd = random.Random(7)
    base = [f"b{i}" for i in range(146)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rnd.randint(1, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(3)}"
        rows.append((i, " ".join(w)))
    from test_registered import components as brute

    want = brute([(i, t, None) for i, t in rows], k, percent)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()}
    assert got == want


def test_ngram_join_mixed_groups(spark):
    """A pair just at the threshold whose shared prefix shingles are, in order, of a large group, small ones with other pivots, a large one."""
    rnd = random.Random(5)
    tail, pool = [f"t{i}" for i in range(89)], [f"r{i}" for i in range(120)]
    texts = [" ".join(tail + [f"h{i}" for i in range(120)])] * 100 + [" ".join(pool)] * 100
    linked = []
    for g in range(3):
        small, first, last = [f"f{g}_{i}" for i in range(4)], f"m{g}", f"n{g}"
        for q in range(10):
            texts += [" ".join([*small, f"q{g}_{q}", *rnd.sample(pool, 35)])] * 5
        linked.append((len(texts), len(texts) + 1))
        texts += [" ".join([*(f"{own}{g}_{i}" for i in range(5)), first, *small, last, *tail]) for own in "px"]
        texts += [" ".join([first, last, *rnd.sample(pool, 28)]) for _ in range(38)]
        texts += [" ".join([last, *rnd.sample(pool, 29)]) for _ in range(30)]
    from test_registered import components as brute

    rows = list(enumerate(texts))
    want = brute([(i, t, None) for i, t in rows], 1, 90)
    assert all(want[x] == (100, p) for p, x in linked)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=90).collect()}
    assert got == want


def test_trie():
    sets = [np.array(s) for s in ([0, 1, 2, 3], [0, 1, 2, 4], [0, 1, 5, 6], [7, 8, 9, 10], [0, 1, 2])]
    order = sorted(range(5), key=lambda i: sets[i].tolist())
    assert sorted(ngram_join.trie_partners(np.array([0, 1, 2, 3]), sets, order, 60)) == [0, 1, 4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 200: 200, 201: 200}


def test_suffix_dedup(spark, none):
    shared = "".join(random.Random(3).choices("abcdefgh", k=500))
    rows = [(1, "aaa " + shared), (2, shared + " bbb"), (3, None), (4, shared[:399]), (5, "z" * 450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in suffix_dedup.remove_repeats(docs, keep="none", with_bytes=True).collect()}
    assert [bytes(got[i]["kept"]) for i in (1, 2, 3, 4, 5)] == [b"aaa ", b" bbb", b"", shared[:399].encode(), b""]
    first = {r["id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs, keep="first").collect()}
    assert first == {1: (0, 0), 2: (500, 1), 3: (0, 0), 4: (0, 0), 5: (449, 1)}
    crowded = {r["id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs, keep="none", task_contexts=1).collect()}
    assert crowded == {i: r["n_removed"] for i, r in got.items()}
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_periodic_texts(spark):
    """Equal runs side by side are one row, and still give what a search over all strings gives."""
    rnd = random.Random(9)
    noise = ["".join(rnd.choices("abcdefgh", k=k)) for k in (30, 45, 60)]
    texts = ["z" * 500, noise[0] + "z" * 300 + noise[1], "ha " * 90 + noise[2], noise[1] + "ha " * 20, "y" * 25, "abcdefghij" * 30, noise[0] + "abcdefghij" * 4, "ha " * 90 + noise[2]]
    min_len, gram = 20, 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["id", "rk", "th", "text"])
    found = [r for out in suffix_dedup._anchor_rows(min_len, gram)([batch]) for r in out.to_pylist()]
    # 481 runs of one window each
    assert sum(r["id"] == 0 for r in found) == 1
    assert [(r["lo"], r["hi"], r["more"]) for r in found if r["id"] == 0] == [(0, 0, 480)]
    for i, text in enumerate(texts):
        assert sum((r["more"] + 1) * (r["hi"] - r["lo"] + 1) for r in found if r["id"] == i) == len(text) - min_len + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = [(i, a) for i, t in enumerate(texts) for a in range(len(t) - min_len + 1)]
    groups: dict[str, list] = {}
    for i, a in places:
        groups.setdefault(texts[i][a : a + min_len], []).append((i, a))
    for keep in ("none", "first"):
        want = {i: bytearray(len(t)) for i, t in enumerate(texts)}
        for same in groups.values():
            for i, a in same[1:] if keep == "first" else same if len(same) > 1 else []:
                want[i][a : a + min_len] = b"\1" * min_len
        left = {i: bytes(c for c, g in zip(texts[i].encode(), gone) if not g) for i, gone in want.items()}
        for crowd in (1, 4096):
            got = {r["id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, min_len=min_len, gram=gram, keep=keep, with_bytes=True, task_contexts=crowd).collect()}
            assert got == {i: (sum(want[i]), left[i]) for i in left}


def test_suffix_dedup_kept_text(spark, tmp_path):
    """What is left can be read as text: planted passages are gone, other texts unchanged, cut characters marked, equal rows and null ids each there."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(3, 9))) for _ in range(5000)]
    long, short = (" ".join(rnd.choices(words, k=n)) for n in (70, 51))
    long += " " * (400 - len(long))
    assert len(short) < 400 <= len(long)
    clean = "été " + " ".join(rnd.choices(words, k=200))
    # the shared bytes end inside a character: 0xC3 begins both
    rows = [(1, "eins " + long + "é"), (2, long + "è zwei"), (3, "drei " + short), (4, short + " vier"), (5, clean), (6, None), (7, ""), (8, "x" * 500), (8, "x" * 500), (None, "null " + " ".join(rnd.choices(words, k=90)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = suffix_dedup.op4_suffix_dedup(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = out.collect()
    want = {**dict(rows), 1: "eins \ufffd", 2: "\ufffd zwei", 6: "", 8: ""}
    assert sorted((r["doc_id"] or 0, r["kept_text"]) for r in got) == sorted((i or 0, want[i]) for i, _ in rows)
    for r in got:
        if "\ufffd" not in r["kept_text"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
            assert len(r["kept_text"].encode()) == r["n_bytes"] - r["n_removed"]


def test_suffix_dedup_unmarked_text():
    """A text that only the bitmap lets through has no runs and is left whole."""
    runs = pa.array([None, [{"lo": 1, "hi": 2}]], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["abcdef", "abcdef"]), runs], ["id", "text", "runs"])
    (out,) = suffix_dedup._cut(3, True)([batch])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in out.to_pylist()] == [(6, 0, 0, b"abcdef"), (6, 4, 1, b"af")]


def test_longest_previous_factors():
    """Suffix order, previous and next smaller places against a direct search, over several texts of few letters."""
    rnd = random.Random(11)
    for min_len in (1, 2, 5):
        texts = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 40))) for _ in range(6)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        at = [bytes(data[i : i + min_len]) if i + min_len <= end[i] else None for i in range(len(data))]
        earlier, later = suffix_dedup.previous_and_next(data, end, min_len)
        assert earlier.tolist() == [x is not None and x in at[:i] for i, x in enumerate(at)]
        assert later.tolist() == [x is not None and x in at[i + 1 :] for i, x in enumerate(at)]


def test_factor_lengths():
    data = np.frombuffer(b"abaababaab", np.uint8)
    end = np.full(len(data), len(data))
    order, ranks = suffix_dedup.suffix_order(data, end, 16)
    assert order.tolist() == sorted(range(10), key=lambda i: bytes(data[i:]))
    lcp = np.concatenate([[0], suffix_dedup.common_prefixes(order[:-1], order[1:], end, ranks)])
    got = dict(zip(order.tolist(), suffix_dedup._factors(order, lcp).tolist()))
    text = bytes(data)
    want = {i: max([n for j in range(i) for n in range(len(text) - i + 1) if text[i : i + n] == text[j : j + n]], default=0) for i in range(10)}
    assert got == want


def test_language(docs, none):
    model = langid.train(docs)
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs.withColumn("score", F.lit("x")), model).collect()]
    assert len(rows) == 10 and {(i, p, s) for i, p, s in rows if i in (4, 5, 6)} == {(4, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0)}
    assert langid.train(none) is None and {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def _fixed_model(families, family_margins, pair_margin):
    """Machines that say the same of every text."""
    model = langid.Model.__new__(langid.Model)
    model.langs, model.families, model.pairs, model.n_family = ["de", "en", "es", "fi"], families, [(0, 1)], len(families)
    model.b = np.array([*family_margins, pair_margin])
    model.w = np.zeros((langid.DIMS, len(model.b)))
    return model


def test_language_stage_keeps_even_odds(docs, monkeypatch):
    """0.6 from the family machines and 0.6 from the pair machines: the score is 0.36, and the documents stay."""
    three = [[0, 1], [2], [3]]
    model = _fixed_model(three, [np.log(3) / 2, 0, 0], np.log(1.5) / 3)
    lang, score, odds = model.predict(langid.features(b"two words"))
    assert lang == "de" and round(score, 6) == 0.36 and round(odds, 6) == 0.6
    monkeypatch.setattr(corpus_pipeline, "train", lambda labelled: model)
    kept = corpus_pipeline.language(docs.sparkSession, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 3, 7, 8]
    # one language a family, 0.33 each: no machine gives even odds
    monkeypatch.setattr(corpus_pipeline, "train", lambda labelled: _fixed_model([[2], [1], [3]], [0, 0, 0], 0))
    assert corpus_pipeline.language(docs.sparkSession, docs, "").count() == 0


def test_quality(docs, none):
    rows = {r["id"]: (r["score"], r["kept"]) for r in quality.score_quality(docs).collect()}
    assert rows[4] == rows[5] == (0.0, False) and quality.score_quality(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mixed_sizes(docs.withColumns({"size": F.lit(1), "shard": F.lit(2)})).collect()
    assert len(rows) == 10 and all(r["taken"] == 0 for r in rows if r["size"] == 0) and mixing.mixed_sizes(none).count() == 0


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert mixing.water_fill([10, 1000], [1000, 1]) == [30.0, 980.0]


def test_splitting_tree():
    draws = np.array([1000, 0, 77, 5])
    parts = [mixing.shard_quotas(draws, s, 7, 3) for s in range(7)]
    assert (sum(c for _, c in parts) == draws).all()
    for (a, n), (b, _) in zip(parts, parts[1:]):
        assert (a + n == b).all()


def test_decontamination(spark, docs, none):
    item = " ".join(f"item{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "before " * 30 + item.upper() + " after" * 30), (2, item.replace("item20", "other")), (3, "clean text " * 50), (4, None)], "doc_id long, text string")
    got = sorted((r["id"], r["item"]) for r in decontaminate.contaminated(rows.withColumn("size", F.lit(1)), bench).collect())
    assert got[:2] == [(1, 1), (1, 4)] and all(i in (1, 2) for i, _ in got)
    assert decontaminate.contaminated(none, bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net"), (3, None), (4, "no scheme"), (5, "x://evilnet/"), (6, "x://www.org/fr/a"), (7, "x://example.com/de/y"), (7, "x://example.com/de/y"), (8, "x://net?/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.RULES).collect())
    assert [g[3:] for g in got] == [("example.net/en/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/fr/", "allow"), ("example.com/de/", "block"), ("example.com/de/", "block"), (None, "allow")]
    assert got[0][1:3] == ("a.example.net", "/en/x") and url_filter.judge_urls(pages.limit(0), url_filter.RULES).count() == 0


def test_chat_round_trip(spark):
    t = chat_format.Template()
    texts = ["<|turn|>user", "a\\b<|end|>", "\\", "<<SYS>></s>", "", None, "[/INST]\\<"]
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(texts)] + [(None, None, None, None)]
    out = chat_format.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t)
    last = out.where("is_last and conv_id = 1").select(chat_format.parse(F.col("formatted"), t).alias("turns")).first()["turns"]
    assert [(x["role"], x["text"]) for x in last] == [("assistant" if i % 2 else "user", x or "") for i, x in enumerate(texts)]
    assert [r[0] for r in out.where("trained").orderBy("example").select(chat_format.loss_text(t)).collect()] == [texts[1], texts[3], ""]
    assert out.where("conv_id is null").count() == 1


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 200_000
    rows = [(1, "http://a\r\nb", big), (2, "u", big), (3, None, None), (4, "u", "WARC/1.1\r\n\r\n"), (5, "u", "small"), (6, "u", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read_pages(spark, f"file://{tmp_path}/w").collect()}
    assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"], r["error"]) for i, r in got.items()} == {
        1: ("revisit", 2, 200_000, None), 2: ("response", None, 200_000, None), 3: ("response", None, 0, None), 4: ("response", None, 12, None), 5: ("response", None, 5, None), 6: ("response", None, 5, None)}
    assert bytes(got[2]["payload"]) == big.encode() and got[2]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()


def test_warc_segments(spark):
    block = warc._HTTP + warc.chunked(b"payload" * 9)
    parts = [block[a : a + 40] for a in range(0, len(block), 40)]
    rec = lambda o, i, total, b: (f"{o}{i}", "response" if i == 1 else "continuation", 1, None, None, None, i, None if i == 1 else f"{o}1", total, b, None)
    rows = [rec("ok", i, len(block) if i == len(parts) else None, p) for i, p in enumerate(parts, 1)][::-1] + [rec("gap", i, len(block), p) for i, p in enumerate(parts, 1) if i != 2] + [rec("len", i, 7, p) for i, p in enumerate(parts, 1)]
    got = {r["record_id"]: r for r in warc.reassembled(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert bytes(got["ok1"]["payload"]) == b"payload" * 9
    assert "missing" in got["gap1"]["error"] and "total length" in got["len1"]["error"]


def test_chat_ties_and_empty(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "y"), (1, 0, "user", "a", "y"), (1, 1, "assistant", "c" * 100_000, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat_format.expand(turns).where("is_last").select("n_turns", chat_format.parse(F.col("formatted")).alias("t")).first()
    assert got["n_turns"] == 4 and [x["text"] for x in got["t"]] == ["a", "a", "b", "c" * 100_000]
    assert chat_format.expand(turns.limit(0)).count() == 0


def test_warc_edges(spark, tmp_path):
    """An empty table, repeated rows, columns with the operator's own names, and payloads over one segment."""
    page = "é" * 9000
    rows = [(1, "u", page), (1, "u", page), (None, "u", page), (2, "u", "x" * 999), (2, "u", "x" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit("s"), "payload": F.lit("p"), "head": F.lit(7)})
    warc.write_warc(pages, f"file://{tmp_path}/w", row_bytes=5000, rows_per_file=2)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["error"]) for r in warc.read_pages(spark, f"file://{tmp_path}/w").collect()), key=repr)
    assert got == sorted([(1, "response", None, 18_000, None), (1, "response", None, 18_000, None), (None, "revisit", 1, 18_000, None), (2, "response", None, 999, None), (2, "response", None, 999, None)], key=repr)
    kinds = {r["record_type"]: r["count"] for r in warc.read_records(spark, f"file://{tmp_path}/w").groupBy("record_type").count().collect()}
    assert kinds["continuation"] >= 4 and len(list((tmp_path / "w").glob("part-*"))) > 1
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_pages(spark, f"file://{tmp_path}/none").count() == 0


def test_decontamination_between_diagonals(spark):
    """The best window lies between the places where item and document share shingles."""
    w = [f"w{i}" for i in range(94)]
    doc = ["a1", "a2", "a3", *w[3:47], *[f"n{i}" for i in range(6)], *w[47:91], "z1", "z2", "z3"]
    shingles = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
    item = shingles(w)
    best = max(len(set(item) & set(shingles(doc)[s : s + 90])) for s in range(len(shingles(doc)) - 89))
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    for pad in (0, 40):
        text = " ".join([*(f"p{i}" for i in range(pad)), *doc, *(f"q{i}" for i in range(pad))])
        rows = spark.createDataFrame([(1, text), (1, text), (2, "clean text " * 60)], "doc_id long, text string").withColumns({"th": F.lit(1), "starts": F.lit("x")})
        got = decontaminate.contaminated(rows, bench, threshold=0.75).collect()
        assert [(r["id"], r["item"], round(r["similarity"], 9)) for r in got] == [(1, 1, round(best / (180 - best), 9))]


def test_decontamination_of_many_item_sizes(spark):
    """A text that holds items of many sizes goes through shuffles once, as text, not as words once a size."""
    rnd = random.Random(7)
    word = lambda: f"x{rnd.getrandbits(40):x}"
    items = [(n, " ".join(word() for _ in range(n))) for n in range(20, 50)]
    text = " ".join(part for _, item in items for part in (*(word() for _ in range(1000)), item))
    rows = spark.createDataFrame([(1, text), (None, text), (1, text)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    sc = spark.sparkContext
    stages = lambda: {x.stageId(): x.shuffleWriteBytes() for x in _seq(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()))}
    before = stages()
    got = decontaminate.contaminated(rows, bench).collect()
    assert sorted((r["id"] or 0, r["item"], r["similarity"]) for r in got) == [(d, n, 1.0) for d in (0, 1) for n, _ in items]
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < sum(v for k, v in stages().items() if k not in before) < 8 * len(text)


def _seq(xs):
    return [xs.apply(i) for i in range(xs.size())]


def test_simhash(spark):
    """Counters side by side against counting bit by bit."""
    rnd = random.Random(2)
    arrays = [[rnd.getrandbits(64) - (1 << 63) for _ in range(n)] * (1 + n % 2) for n in (1, 2, 3, 7, 50, 255)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<long>")
    got = {r["i"]: r["s"] for r in df.select("i", decontaminate.simhash(F.col("a"), 510).alias("s")).collect()}
    for i, a in enumerate(arrays):
        bits = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in a) > len(a))
        assert got[i] == (bits - (1 << 64) if bits >> 63 else bits)


def test_large_hypergeometric():
    """The sampler for large counts has the mean and spread of the distribution, and agrees with numpy's on small ones."""
    rng = np.random.default_rng(1)
    for good, bad, take in ((70, 30, 20), (30, 70, 95), (5 * 10**10, 3 * 10**11, 10**11)):
        x = np.array([mixing.large_hypergeometric(good, bad, take, rng) for _ in range(4000)], float)
        p, n = good / (good + bad), good + bad
        sd = (take * p * (1 - p) * (n - take) / (n - 1)) ** 0.5
        assert abs(x.mean() - take * p) < 5 * sd / 4000**0.5 and abs(x.std() / sd - 1) < 0.06
        assert x.min() >= max(0, take - bad) and x.max() <= min(good, take)


def test_several_shards(docs):
    placed, sources = mixing.measured(docs)
    plan = mixing.plan_sources(sources, block_words=8)
    pieces = mixing.write_shards(mixing.mix(placed, plan, shards=5, block_words=8)).collect()
    want = {r["source_no"]: r["draws"] for r in plan.collect()}
    quotas = mixing.shard_quotas(np.array([want[i] for i in sorted(want)]), 2, 5, mixing.SEED)[1]
    assert len({r["shard"] for r in pieces}) == 5
    drawn = {(r["source_no"], r["epoch"], (r["first_word"] + r["piece_start"]) // 8) for r in pieces}
    assert {s: sum(1 for x in drawn if x[0] == s) for s in want} == want
    mine = {(r["source_no"], r["epoch"], (r["first_word"] + r["piece_start"]) // 8) for r in pieces if r["shard"] == 2}
    assert [sum(1 for x in mine if x[0] == s) for s in sorted(want)] == quotas.tolist()


def test_letters():
    assert [t is None for t in langid._texts(pa.array(["²½①", "123 _", "a", None, "", "½é"]))] == [True, True, False, True, True, False]


def test_label_model():
    """Expectation-maximisation against a direct computation of one step from its result: the posterior is a fixed point."""
    counts = {sum(v * 3**i for i, v in enumerate(c)): n for c, n in (((2, 2, 2, 2, 2, 2, 2, 2), 900), ((1, 2, 2, 2, 2, 2, 2, 2), 40), ((1, 1, 2, 2, 1, 2, 2, 1), 30), ((0, 0, 2, 2, 2, 0, 2, 2), 60))}
    got = quality.label_model(counts)
    prior = [[0.2, 0.002, 0.798], [0.35, 0.25, 0.4]]
    said = {c: [(c // 3**j) % 3 for j in range(8)] for c in counts}
    weigh = []
    for side in (0, 1):
        mass = {c: n * (got[c] if side == 0 else 1 - got[c]) for c, n in counts.items()}
        share = sum(mass.values()) / sum(counts.values())
        row = {}
        for c in counts:
            p = min(0.99, max(0.01, share))
            for j in range(8):
                seen = [sum(m for k, m in mass.items() if said[k][j] == v) + quality.PRIOR_DOCS * prior[side][v] for v in range(3)]
                p *= seen[said[c][j]] / sum(seen)
            row[c] = p
        weigh.append(row)
    for c in counts:
        assert abs(got[c] - weigh[0][c] / (weigh[0][c] + weigh[1][c])) < 1e-4


def test_exact_dedup_by_locator(spark, tmp_path):
    """Locators name file and row; bytes behind an equal digest of an earlier call are compared too."""
    spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    got = {r["id"]: r["keep_locator"] for r in exact_dedup.exact_dedup(spark.read.parquet(f"file://{tmp_path}/d")).collect()}
    assert got[1] == got[2] and got[1].endswith("#1") and got[3].endswith("#2") and ".parquet" in got[1]
    same = lambda c: F.lit("x").cast("binary")
    run = lambda rows: sorted((r["id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=same, checkpoint=f"file://{tmp_path}/s").collect())
    assert run([(1, "a"), (5, "b")]) == [(1, 1, 1), (5, 5, 1)]
    assert run([(3, "A"), (9, "c")]) == [(3, 3, 2), (9, 9, 1)]


@pytest.mark.parametrize("body", [b"5\r\nab", b"zz\r\n", b"3\r\nabcX\r\n0\r\n\r\n"])
def test_broken_chunks(body):
    with pytest.raises(ValueError):
        warc.dechunked(body)


def test_word_slices():
    """Texts over one slice hash like short ones."""
    from fluxledger.llm.shingles import SLICE, word_hashes

    text = "alpha " * (SLICE // 6 + 100)
    words, first = word_hashes(pa.array([text, "alpha", None]))
    assert len(set(words.tolist())) == 1 and first.tolist()[-2:] == [len(words), len(words)]
