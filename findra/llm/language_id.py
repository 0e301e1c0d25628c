"""Language ID by string kernels: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest kernel ridge regression.

A passage's spectrum is the set of byte n-grams (1 to 4 bytes of its lower-cased letters, everything else a
space) that occur in it, hashed to ``BINS`` bins a length. The kernel of two passages is the mean over the
lengths of ``|A and B| / sqrt(|A| |B|)``; that of two texts the mean over all their pairs of passages of
about ``PASSAGE`` bytes, so that long texts, and texts in several languages, are judged by all their
parts. Landmarks are training texts; a text's Nyström features are its
kernel values against them, times the inverse root of the landmarks' own kernel matrix. Ridge regression
on these features gives a score for each language.

As the kernel is linear in presence, landmark spectra, whitening and regression multiply into one matrix
(bins x languages) a length: a text is scored by the products of its weighted spectra with them.

Training uses at most ``PER_LANGUAGE`` labelled documents of each language, and of all languages together
``MOST_DOCUMENTS`` (of each fewer, then, but one at least: no language is left out), those with the
smallest hash of their id, each by its whole text; it runs on the driver, in memory that these two
and the number of languages bound.

Defined results: a null text or one without a letter (a character of a category L) is ``und`` with score 0,
as is every text where nothing was learned; an empty table gives no rows; a very long text is judged as
a whole, in memory proportional to its length; other columns are ignored or kept, but a column
of an output's name is replaced; rows are judged each by itself, so repeated rows
get equal results; ties between languages go to the first in alphabetical order; null languages are not
learned from, and neither are rows with null ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, held_out, labelled_sample, table, text_batches, texts_of, unused

LENGTHS = (1, 2, 3, 4)
BIN_BITS = 13
BINS = 1 << BIN_BITS
#: Bytes in a passage, about.
PASSAGE = 400
PER_LANGUAGE = 150
MOST_DOCUMENTS = 6_000
LANDMARKS = 256
#: Training texts whose spectra are held as dense rows at once.
DENSE_ROWS = 256
RIDGE = 1e-3
SHARPNESS = 8.0
UNKNOWN = "und"

#: Letters, and some numbers that ``str.isalpha`` tells from them.
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def spectra(text: str) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of passages, and for each n-gram length the bins that occur in them with their weights.

    A bin's weight is one over the root of its passage's number of bins, over the number of passages.
    """
    raw = b" %s " % b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split())
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    k = max(1, round(len(a) / PASSAGE))
    of = (np.arange(len(a)) * k // len(a)).astype(np.int64) * BINS
    out, code = [], np.zeros(len(a), np.uint32)
    for n in LENGTHS:
        m = len(a) - n + 1
        if m <= 0:
            out.append((np.empty(0, np.int64), np.empty(0, np.float32)))
            continue
        code = (code[:m] << np.uint32(8)) | a[n - 1 :]
        seen = np.zeros(k * BINS, bool)
        seen[of[:m] + ((code * np.uint32(2654435761)) >> np.uint32(32 - BIN_BITS))] = True
        at = np.flatnonzero(seen)
        passage = at >> BIN_BITS
        weight = 1 / (k * np.sqrt(np.bincount(passage, minlength=k).astype(np.float32)))
        out.append((at & (BINS - 1), weight[passage].astype(np.float32)))
    return k, out


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    """``tables[i]``: bins x languages for the i-th n-gram length."""

    languages: list[str]
    tables: list[np.ndarray]

    def scores(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for (bins, weight), t in zip(spectra(text)[1], self.tables, strict=True):
            total += weight @ t[bins]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        s = SHARPNESS * self.scores(text)
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _presence(texts: list[str]) -> list[np.ndarray]:
    """Texts x bins for each length: mean of the passages' spectra, each of length 1."""
    out = [np.zeros((len(texts), BINS), np.float32) for _ in LENGTHS]
    for i, t in enumerate(texts):
        for x, (bins, weight) in zip(out, spectra(t)[1], strict=True):
            np.add.at(x[i], bins, weight)
    return out


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from labelled texts; landmarks are taken in turn from each language."""
    names = sorted(set(languages))
    if not names:
        return Model([], [np.zeros((BINS, 0)) for _ in LENGTHS])
    turn: dict[str, int] = {}
    order = []
    for i, lang in enumerate(languages):
        turn[lang] = turn.get(lang, 0) + 1
        order.append((turn[lang], i))
    marks = [i for _, i in sorted(order)[: max(landmarks, len(names))]]
    lm = _presence([texts[i] for i in marks])
    weight = 1 / len(LENGTHS)
    inner = weight * sum(m @ m.T for m in lm)
    values, vectors = np.linalg.eigh(inner.astype(np.float64))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    white = vectors[:, keep] / np.sqrt(values[keep])
    kernels = [sum(a @ b.T for a, b in zip(_presence(texts[lo : lo + DENSE_ROWS]), lm, strict=True)) for lo in range(0, len(texts), DENSE_ROWS)]
    phi = weight * np.concatenate(kernels).astype(np.float64) @ white
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    counts = np.array([languages.count(n) for n in names], float)
    balance = np.sqrt(1 / counts[[names.index(v) for v in languages]])[:, None]
    a = phi * balance
    w = np.linalg.solve(a.T @ a + ridge * np.trace(a.T @ a) / a.shape[1] * np.eye(a.shape[1]), a.T @ (y * balance))
    mix = white @ w
    return Model(names, [(weight * (m.T.astype(np.float64) @ mix)).astype(np.float32) for m in lm])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 5, remainder: int = 0, per_language: int = PER_LANGUAGE, most: int = MOST_DOCUMENTS) -> Model:
    """A model from the documents whose id is not held out."""
    labels = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("label"))
    sample = labelled_sample(labels.where(~held_out(F.col("id"), modulus, remainder)), per_language, most)
    got = texts_of(docs, [*sample], doc_id, text)
    return fit([t for _, t in got], [sample[i] for i, _ in got])


def predict(docs: DataFrame, model: Model, text: str = "text", lang_name: str = "lang_pred", score_name: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x lengths numbers a language

    @F.pandas_udf("lang string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = pd.DataFrame([m.predict(t) for t in texts], columns=["lang", "score"])
        give_back()
        return out

    found = unused(docs, "judged")
    out = docs.withColumn(found, judged(F.col(text)))
    return out.withColumns({lang_name: F.col(f"{found}.lang"), score_name: F.col(f"{found}.score")}).drop(found)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
