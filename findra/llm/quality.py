"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded as shares of character
kinds, word statistics, repetition (within the passage and against the document so far), and its
lower-cased byte n-grams of 2 to 4 (words with a space on both sides) hashed to ``GRAM_BINS`` signed
bins. Gated
attention ``softmax_k(w . (tanh(V h_k) * sigmoid(U h_k)))`` weighs the encoded passages; the weighted
sum, through one logistic unit, is the document's score. Only document labels are used; encoder,
attention and output are learned together with Adam on the driver; a bag's loss is the logistic one, each label of equal weight.

Training uses at most ``PER_LABEL`` labelled documents of each label, each by its whole text.

Defined results: a null or empty text is one passage of zeros and gets a score like any other; where
nothing was learned, or one label only, every score is that label's share (0.5 without labels); rows are
judged each by itself, so repeated rows get equal results and ties stay ties; a very long text is judged
as a whole, in memory proportional to its length; an empty table gives no rows; other columns are kept,
but one of the score's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, table, text_batches, texts_of

PASSAGE = 48
PER_LABEL = 600
HIDDEN = 24
ATTENTION = 12
EPOCHS = 40
RATE = 0.02
DECAY = 1e-4
SEED = 7
THRESHOLD = 0.5

_KINDS = 8
GRAMS = (2, 3, 4)
GRAM_BINS = 96
N_FEATURES = _KINDS + 6 + GRAM_BINS


def _byte_kinds() -> np.ndarray:
    """Kind of each byte: lower, upper, digit, white space, sentence marks, brackets and quotes, other marks, non-ASCII."""

    def kind(b: int) -> int:
        c = chr(b)
        if b >= 0x80:
            return 7
        if c.isalpha():
            return 0 if c.islower() else 1
        if c.isdigit():
            return 2
        if c.isspace() or b < 0x20:
            return 3
        return 4 if c in ".,;:" else 5 if c in "()[]{}'\"<>" else 6

    return np.array([kind(b) for b in range(256)], np.uint8)


_KIND = _byte_kinds()


def _hashed_grams(words: list[bytes], of: np.ndarray, k: int) -> np.ndarray:
    """Passages x ``GRAM_BINS``: signed counts of the passages' n-grams, over the root of their number."""
    raw = np.frombuffer(b" " + b" ".join(words).lower() + b" ", np.uint8).astype(np.uint32)
    # The passage of each byte: that of the word it belongs to or stands before.
    owner = np.append(np.repeat(of, np.fromiter(map(len, words), np.int64, len(words)) + 1), of[-1])
    out, code = np.zeros(k * GRAM_BINS), np.zeros(len(raw), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | raw[n - 1 :]
        if n in GRAMS:
            h = (code + np.uint32(n)) * np.uint32(2654435761)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
            sign = ((h >> np.uint32(31)).astype(np.int8) << 1) - 1
            out += np.bincount(owner[:m] * GRAM_BINS + ((h >> np.uint32(8)) % np.uint32(GRAM_BINS)), sign, minlength=k * GRAM_BINS)
    size = np.bincount(owner, minlength=k)
    return out.reshape(k, GRAM_BINS) / np.sqrt(size)[:, None]


def encode(text: str | None) -> np.ndarray:
    """Passages x ``N_FEATURES``; time and memory in proportion to the text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    k = -(-n // PASSAGE)
    sizes = np.fromiter(map(len, words), np.int64, n)
    of = np.arange(n) // PASSAGE
    count = np.bincount(of, minlength=k).astype(np.float64)
    kinds = _KIND[np.frombuffer(b"".join(words), np.uint8)]
    byte_of = np.repeat(of, sizes)
    hist = np.bincount(byte_of * _KINDS + kinds, minlength=k * _KINDS).reshape(k, _KINDS).astype(np.float64)
    chars = hist.sum(axis=1, keepdims=True)
    hist = hist / chars
    # Words as numbers in order of first appearance, for repetition.
    seen: dict[bytes, int] = {}
    ident = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    first = np.zeros(n, bool)
    first[np.unique(ident, return_index=True)[1]] = True
    again = np.zeros(n)
    again[1:] = ident[1:] == ident[:-1]
    pairs = of * (n + 1) + ident
    own = np.bincount(np.unique(pairs) // (n + 1), minlength=k)
    mean = np.bincount(of, sizes, minlength=k) / count
    var = np.bincount(of, sizes.astype(float) ** 2, minlength=k) / count - mean**2
    stats = np.stack([
        own / count,
        np.bincount(of, first, minlength=k) / count,
        np.bincount(of, again, minlength=k) / count,
        np.log1p(mean) / 3,
        np.log1p(np.maximum(var, 0)) / 4,
        count / PASSAGE,
    ], axis=1)
    return np.concatenate([hist, stats, _hashed_grams(words, of, k)], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Parameters: encoder ``E, e``, attention ``V, U, w``, output ``o, b``; inputs are shifted and scaled."""

    shift: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    params: dict = field(default_factory=dict)
    constant: float | None = 0.5

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray):
        """Scores of bags of passages: ``starts`` are the bags' first rows, ``bag`` the bag of each row."""
        p = self.params
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        a = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = a / np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, _sigmoid(z @ p["o"] + p["b"])

    def gradients(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the bags' mean weighted logistic loss by every parameter."""
        p = self.params
        h, t, g, a, z, out = self.forward(x, starts, bag)
        d = (out - y) * weight / len(y)
        dz = d[:, None] * p["o"]
        dh = a[:, None] * dz[bag]
        da = np.einsum("ij,ij->i", h, dz[bag])
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = dh + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h**2)
        return {"E": x.T @ dx, "e": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "o": z.T @ d, "b": d.sum(keepdims=True)}

    def scores(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Score of each bag and the attention weights of its passages."""
        if self.constant is not None:
            return np.full(len(bags), self.constant), [np.full(len(b), 1 / len(b)) for b in bags]
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = (np.concatenate(bags) - self.shift) / self.scale
        _, _, _, a, _, y = self.forward(x, starts, np.repeat(np.arange(len(bags)), sizes))
        return y, np.split(a, starts[1:])


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Trains on whole texts with document labels 0 and 1; both labels weigh the same together."""
    if len(set(labels)) < 2:
        return Model(constant=float(labels[0]) if labels else 0.5)
    rng = np.random.default_rng(SEED)
    bags = [encode(t) for t in texts]
    y = np.array(labels, float)
    flat = np.concatenate(bags)
    m = Model(flat.mean(axis=0), flat.std(axis=0) + 1e-3, {}, None)
    m.params = {
        "E": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "e": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION),
        "o": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
    }
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    first = {k: np.zeros_like(v) for k, v in m.params.items()}
    second = {k: np.zeros_like(v) for k, v in m.params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            sizes = np.array([len(bags[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bag = np.repeat(np.arange(len(pick)), sizes)
            x = (np.concatenate([bags[i] for i in pick]) - m.shift) / m.scale
            p = m.params
            step += 1
            for k, v in m.gradients(x, starts, bag, y[pick], weight[pick]).items():
                v = v + DECAY * p[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", modulus: int = 3, remainder: int = 1, per_label: int = PER_LABEL) -> Model:
    """A model from the labelled documents whose id is not held out."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    sample = labelled_sample(rows.where(~held_out(F.col("id"), modulus, remainder)), per_label)
    got = texts_of(docs, [*sample], doc_id, text)
    return fit([t for _, t in got], [sample[i] for i, _ in got])


def score(docs: DataFrame, model: Model, text: str = "text", score_name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out, values = [], texts.tolist()
        for lo in range(0, len(values), 128):
            out.append(shared.value.scores([encode(t) for t in values[lo : lo + 128]])[0])
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(score_name, scored(F.col(text)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), score_name="score")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
