"""The pipeline's stages and the whole against brute force, on rows with copies, leaks, repeated and null ids."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipe
from fluxledger.llm import langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rnd = random.Random(4)
    text = lambda n: " ".join(f"t{rnd.randrange(5000)}" for _ in range(n))
    a, b, leak = text(120), text(80), " ".join(f"item{i}" for i in range(40))
    near = a.replace(a.split()[60], "changed")
    out = [(1, a), (3, a.upper()), (3, near), (3, b), (None, b), (None, f"{text(30)} {leak} {text(30)}"), (7, f"{text(50)} {leak}"), (7, text(90)), (8, None), (9, ""), (10, "123 ½ ²"), (None, text(60)), (11, text(3000))]
    out += [(20 + i, text(rnd.randrange(1, 200))) for i in range(30)]
    out = [(i, t, "en", "abc"[k % 3] if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(out)]
    return [*out, out[0], out[3], out[-1], out[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(40))), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def collected(df, n=5):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


def fixed(monkeypatch):
    """One language: every text with a letter is it."""
    model = langid.Model.__new__(langid.Model)
    model.langs, model.families, model.pairs, model.n_family = ["en"], [[0]], [], 0
    model.b, model.w = np.zeros(0), np.zeros((langid.DIMS, 0))
    monkeypatch.setattr(pipe, "train", lambda labelled: model)


def b_language(rs):
    return [r for r in rs if r[1] and any(c.isalpha() for c in r[1])]


def b_exact(rs):
    groups = defaultdict(list)
    for r in rs:
        groups[(r[1] or "").translate(LOWER)].append(r)
    return [max((r[0] is not None, r[0] or 0) for r in g) for g in groups.values()], groups


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def b_near(rs):
    rs = sorted(set(rs), key=repr)
    sets, root = [shingles(r[1]) for r in rs], list(range(len(rs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rs)):
        for j in range(i):
            if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rs):
        groups[find(i)].append(r)
    return list(groups.values())


def leaks(text):
    return "item39" in (text or "")


def test_language(docs, sf_dir, monkeypatch):
    fixed(monkeypatch)
    assert collected(pipe.language(docs.sparkSession, docs, sf_dir)) == sorted(b_language(rows()), key=repr)


def test_exact_copies(docs, sf_dir):
    ids, groups = b_exact(rows())
    got = collected(pipe.exact_copies(docs.sparkSession, docs, sf_dir))
    assert len(got) == len(groups) and set(got) <= set(rows())
    assert {(r[1] or "").translate(LOWER): (r[0] is not None, r[0] or 0) for r in got} == dict(zip(groups, ids))


def test_near_copies(docs, sf_dir):
    got = collected(pipe.near_copies(docs.sparkSession, docs, sf_dir))
    groups = b_near(rows())
    assert len(got) == len(groups)
    for g in groups:
        mine = [r for r in got if r in g]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in g)


def test_decontaminated(docs, sf_dir):
    got = collected(pipe.decontaminated(docs.sparkSession, docs, sf_dir))
    assert got == sorted((r for r in rows() if not leaks(r[1])), key=repr)


def test_decontaminated_shuffles_little(spark, tmp_path):
    """A text that holds items of many sizes goes through shuffles as text, not as words once a size."""
    rnd = random.Random(9)
    text = lambda n: " ".join(f"x{rnd.getrandbits(40):x}" for _ in range(n))
    items = [text(n) for n in range(20, 50)]
    leaky, clean = " ".join(f"{text(1000)} {i}" for i in items), text(100)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, leaky, "en", "a", len(leaky)), (1, clean, "en", "a", len(clean))]
    sc = spark.sparkContext
    found = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    written = lambda: {x.stageId(): x.shuffleWriteBytes() for x in map(found().apply, range(found().size()))}
    before = written()
    assert collected(pipe.decontaminated(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))) == [rows[1]]
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < sum(v for k, v in written().items() if k not in before) < 8 * len(leaky)


def test_mixture(docs, sf_dir):
    out = pipe.mixture(docs.sparkSession, docs, sf_dir)
    got = [r.asDict() for r in out.collect()]
    left = sorted(rows(), key=repr)
    by, taken = defaultdict(int), defaultdict(int)
    for r in rows():
        by[r[3]] += len(WORD.findall(r[1] or ""))
    for r in got:
        left.remove(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")))  # each at most as often as it is there
        assert r["size"] == len(WORD.findall(r["text"])) and r["source_size"] == by[r["source"]] and 0 < r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    target = {r["source"]: r["target"] for r in got}
    assert all(abs(taken[s] - t) <= 128 for s, t in target.items())


@pytest.mark.parametrize("stage", [f for _, f in pipe.STAGES], ids=[n for n, _ in pipe.STAGES])
def test_empty_table_and_extra_columns(docs, sf_dir, stage):
    assert stage(docs.sparkSession, docs.limit(0), sf_dir).count() == 0
    extra = docs.selectExpr("*", "1 as id", "2 as digest", "'x' as component", "3 as score", "4 as _text", "5 as kept").where("doc_id > 19")
    kept = stage(docs.sparkSession, extra, sf_dir)
    assert set(extra.columns) <= set(kept.columns)
    if stage is not pipe.language:
        assert 0 < kept.count() <= extra.count()


def test_run(spark, sf_dir, monkeypatch):
    """All stages in turn: each drops what the brute-force version drops."""
    fixed(monkeypatch)
    got = [r.asDict() for r in pipe.run(spark, sf_dir).collect()]
    rs = b_language(rows())
    ids, groups = b_exact(rs)
    stay = [[r for r in g if (r[0] is not None, r[0] or 0) == best] for best, g in zip(ids, groups.values())]
    texts = {r[1] for g in b_near([g[0] for g in stay]) for r in g if not leaks(r[1])}
    lower = {t.translate(LOWER) for t in texts}
    assert {r["text"].translate(LOWER) for r in got} <= lower
    assert len(got) == len({r["text"].translate(LOWER) for r in got}) and not any(leaks(r["text"]) for r in got)
    near = [shingles(r["text"]) for r in got]
    assert not any(100 * len(x & y) >= 80 * len(x | y) for i, x in enumerate(near) for y in near[:i])
    by, taken = defaultdict(int), defaultdict(int)
    for r in got:
        by[r["source"]] = r["source_size"]
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) > 0.9 * sum(by.values())
