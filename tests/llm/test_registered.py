"""Queries of this subpackage against their oracle SQL on the smallest tables, and the contracts that SQL does not cover."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from fluxledger.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    found = duck.execute(ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def components(documents, k, percent):
    """Brute force: every pair of sets."""
    sets = {}
    for i, text, _ in documents:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            m = len(sets[a] & sets[b])
            if m and 100 * m >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_ngram_join"](spark, SF).collect()}
    assert got == components(documents, 3, 90)


def test_suffix_dedup(spark, documents):
    texts = {i: (t or "").encode() for i, t, _ in documents}
    seen = Counter(t[a : a + 400] for t in texts.values() for a in range(len(t) - 399))
    want = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for a in range(len(t) - 399):
            if seen[t[a : a + 400]] > 1:
                gone[a : a + 400] = b"\1" * 400
        rest = bytes(c for c, g in zip(t, gone) if not g)
        want[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    assert got == want


def test_mix(spark, documents):
    rows = QUERIES["op5_mix"](spark, SF).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in documents}
    by = defaultdict(int)
    for i, _, s in documents:
        by[s] += sizes[i]
    source = {i: s for i, _, s in documents}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    taken, target = defaultdict(int), {}
    for r in rows:
        assert r["source_size"] == by[source[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert abs(sum(target.values()) - sum(by.values())) < 1
    for s, t in target.items():
        assert t <= 3 * by[s] + 1e-6 and abs(taken[s] - t) <= max(128, 0.02 * t)
    again = {r["doc_id"]: r["taken"] for r in QUERIES["op5_mix"](spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_language_held_out(spark, duck):
    rows = QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect()
    lang = dict(duck.execute("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    told = [r for r in rows if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in told) >= 0.95 * len(told) > 0


def test_quality_agrees_with_labels(spark, duck):
    label = dict(duck.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = [(r["score"], label[r["doc_id"]]) for r in QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect() if label.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.8 * len(good) * len(bad) > 0
