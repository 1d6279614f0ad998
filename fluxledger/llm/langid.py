"""Language identification by family, then one-versus-one linear SVMs (operator 2).

Features are hashed byte pairs and triples of the whole text (ASCII lower-cased UTF-8), as
relative frequencies. A family machine (one-versus-rest linear SVM) picks the family; within it
one linear SVM per pair of languages votes. All machines are trained here, on at most
`max_training_docs` labelled documents spread evenly over the languages, which is the only
bounded sample; prediction reads every text whole, in pieces, so memory does not follow its length.

Defined results: text that is null or has no letter (str.isalpha) gives `und` with score 0, and so
does everything if no labelled row exists; a language outside FAMILIES is a family of its own; lang,
source and id never enter a prediction, so equal texts get equal predictions. Repeated rows are
predicted row by row and count once in training; equal votes go to the greater support, then to the
language that sorts first; columns named lang_pred, score or odds are replaced, others pass through;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, load

DIMS = 1 << 12
#: Families of closely related languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_PIECE = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(raw: bytes) -> np.ndarray:
    """Relative frequencies of hashed byte pairs and triples."""
    counts = np.zeros(DIMS, np.int64)
    for a in range(0, max(1, len(raw)), _PIECE):
        x = _LOWER[np.frombuffer(raw[a : a + _PIECE + 2], np.uint8)]
        two = (x[:-1] << np.uint32(8)) | x[1:]
        three = (two[:-1] << np.uint32(8)) | x[2:]
        # a piece owns the n-grams that start in it
        for grams, salt in ((two[:_PIECE], 0x9E3779B1), (three[:_PIECE], 0x85EBCA77)):
            counts += np.bincount((grams * np.uint32(salt)) >> np.uint32(20), minlength=DIMS)
    return counts / max(1, counts.sum())


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    """Raw bytes of every text, None where there is no letter."""
    for v in column:
        s = v.as_py()
        # what the pattern finds may be a digit like a raised two, so the character decides
        yield s.encode() if s is not None and any(m.group().isalpha() for m in _LETTER.finditer(s)) else None


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 120, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, L2) by accelerated full-batch gradient steps; classes weigh the same, rows by their share of it. y is +-1."""
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    share = np.ones(len(y)) if share is None else share
    weight = share * np.where(y > 0, 0.5 / max(1e-9, share[y > 0].sum()), 0.5 / max(1e-9, share[y < 0].sum())) * c
    weight = weight.astype(np.float32)
    w, b, pw, pb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    lam = np.float32(1e-3)
    step = np.float32(1.0 / (lam + 2 * float(weight @ (np.einsum("ij,ij->i", x, x) + 1))))
    for t in range(1, rounds + 1):
        m = np.float32((t - 1) / (t + 2))
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y
        pw, pb = w, b
        w, b = vw - step * (lam * vw - 2 * (x.T @ slack)), vb + step * 2 * float(slack.sum())
    return w, b


class Model:
    """Weights of the family machines and of the pair machines, one column each."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = sorted(langs)
        fam = sorted({family_of(v) for v in self.langs})
        self.families = [[i for i, v in enumerate(self.langs) if family_of(v) == f] for f in fam]
        mean, sd = x.mean(0), x.std(0) + 1e-5
        z = ((x - mean) / (sd * np.float32(np.sqrt(x.shape[1])))).astype(np.float32)
        columns: list[tuple[np.ndarray, float]] = []
        if len(fam) > 1:
            for members in self.families:
                columns.append(svm(z, np.where(np.isin(y, members), 1.0, -1.0)))
        self.pairs = [(i, j) for members in self.families for i, j in combinations(members, 2)]
        for i, j in self.pairs:
            own = (y == i) | (y == j)
            columns.append(svm(z[own], np.where(y[own] == i, 1.0, -1.0)))
        self.n_family = len(fam) if len(fam) > 1 else 0
        scale = sd * np.sqrt(x.shape[1])
        self.w = np.stack([w / scale for w, _ in columns], 1) if columns else np.zeros((x.shape[1], 0))
        self.b = np.array([b - float((w / scale) @ mean) for w, b in columns])

    def predict(self, f: np.ndarray) -> tuple[str, float, float]:
        """Language, score and the better of what the family machines and the pair machines give it."""
        margins = f @ self.w + self.b
        sure, family = 1.0, self.families[0]
        if self.n_family:
            m = margins[: self.n_family]
            e = np.exp(2 * (m - m.max()))
            best = int(m.argmax())
            family, sure = self.families[best], float(e[best] / e.sum())
        votes, support = dict.fromkeys(family, 0), dict.fromkeys(family, 0.0)
        for (i, j), m in zip(self.pairs, margins[self.n_family :]):
            if i in votes:
                p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
                votes[i if m > 0 else j] += 1
                support[i] += p
                support[j] += 1 - p
        win = max(family, key=lambda i: (votes[i], support[i], -i))
        inner = support[win] / (len(family) - 1) if len(family) > 1 else 1.0
        said = [p for p, asked in ((sure, self.n_family), (inner, len(family) > 1)) if asked]
        return self.langs[win], float(min(1.0, max(0.0, sure * inner))), float(max(said, default=1.0))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_training_docs: int = 2000) -> Model | None:
    """Fits on about `max_training_docs` rows, about equally many for each language, chosen by a hash of id and text; repeated rows count once."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit("train"), id_col, text_col).alias("h")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").collect()}
    if not counts:
        return None
    each = max(1, max_training_docs // len(counts))
    rate = F.coalesce(*[F.when(F.col("lang") == v, F.lit(min(1.0, each / n))) for v, n in counts.items()])
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < rate * 1_000_000).dropDuplicates(["h", "lang"]).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(v.as_py(), features(t).astype(np.float16).tobytes()) for v, t in zip(batch.column("lang"), _texts(batch.column("text"))) if t is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())], ["lang", "f"])

    got = chosen.mapInArrow(run, "lang string, f binary").collect()
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["f"])))
    x = np.stack([np.frombuffer(r["f"], np.float16) for r in got]).astype(np.float32)
    return Model(langs, x, np.array([langs.index(r["lang"]) for r in got]))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and odds to every row of `docs` (columns of these names are replaced). Only the text goes to Python."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("lang_pred string, score double, odds double")
    def said(texts: pa.Array) -> pa.Array:
        rows = [("und", 0.0, 0.0) if t is None or model is None else model.predict(features(t)) for t in _texts(texts)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "odds"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "odds", "_said")]
    told = docs.withColumn("_said", said(F.col(text_col)))
    return told.select(*[F.col(f"`{c}`") for c in kept], "_said.lang_pred", "_said.score", "_said.odds")


def held_out(id_col: str = "doc_id"):
    """One document in five, by the CRC-32 of its id as text; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
