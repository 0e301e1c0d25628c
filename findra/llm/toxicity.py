"""Toxicity: a linear-chain conditional random field tags toxic spans; forward-backward marginals make document scores and offsets.

Tags are O and T (toxic). A token's emission is the sum of the weights of its hashed features (the
lower-cased word, its prefixes of 2 to 5 and suffixes of 2 to 4 characters, its length, a constant);
transitions are free but O to O, which is 0; before the first token stands O.

Labelled tokens come from labelled documents: a token of a toxic document is T if its word, or a prefix of
it, stands in enough different contexts (neighbouring words, so that copies count once) of toxic
documents and hardly in others. The field is trained on these tags by gradient descent on its exact
likelihood; a logistic unit over two aggregates of the marginals (the largest, the expected number of T)
is then fitted to the document labels.

Forward and backward passes run over all documents of a batch at once: texts are cut into chunks, each
chunk's 2 x 2 transfer matrix is multiplied up side by side with all others, chunks are chained by
document, then the passes run inside all chunks side by side. Cost is linear in tokens.

Training uses at most ``PER_LABEL`` toxic and ``CLEAN_TIMES`` as many other labelled documents, each by its whole
text, on the driver; the field itself half of the former and as many of the latter.

Defined results: a null, empty or wordless text has no token and gets the score of a document without any
toxic sign, and no spans; where nothing was learned, or one label only, every score is that label's share
(0 without labels); rows are judged each by itself, so repeated rows get equal results; an empty table
gives no rows; a very long text is one batch, in memory proportional to its length; ties cannot occur, as
every text has a score of its own; other columns are kept, but one of an output's name is replaced.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_size, held_out, labelled_sample, table, text_batches, texts_of, unused

#: Toxic documents that are learned from at most; CLEAN_TIMES as many others.
PER_LABEL = 800
CLEAN_TIMES = 4
BINS = 1 << 17
STEPS = 60
RATE = 0.6
DECAY = 2e-6
CHUNK = 64
THRESHOLD = 0.7
SPAN_MARGINAL = 0.5
#: A word or prefix is evidence from so many contexts in toxic documents, so large a share of all its contexts, and so high a log-likelihood ratio.
MIN_CONTEXTS = 6
MIN_SHARE = 0.85
MIN_RATIO = 30.0
#: Words whose emission a worker remembers.
CACHE_WORDS = 400_000
#: Characters of text that a worker passes through the field at once (a longer text alone).
BATCH_CHARS = 2_000_000

_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    w = word.lower()
    names = [f"w{w}", f"n{min(len(w), 12)}", "c", *[f"p{w[:k]}" if len(w) > k else f"p{w}$" for k in (2, 3, 4, 5)], *[f"s{w[-k:]}" for k in (2, 3, 4)]]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BINS - 1) for x in names]


N_FEATURES = 10


class Chunks:
    """Layout of documents' tokens in chunks of ``CHUNK`` for passes side by side."""

    def __init__(self, sizes: np.ndarray):
        self.n = int(sizes.sum())
        per_doc = -(-sizes // CHUNK)
        self.total = int(per_doc.sum())
        self.first = np.concatenate([[0], np.cumsum(per_doc)[:-1]]).astype(np.int64)
        self.per_doc = per_doc
        token_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(self.n) - token_start[doc]
        #: Place of each token in the padded layout.
        self.place = (self.first[doc] + within // CHUNK) * CHUNK + within % CHUNK
        self.real = np.zeros(self.total * CHUNK, bool)
        self.real[self.place] = True
        self.real = self.real.reshape(self.total, CHUNK)
        self.doc_of_chunk = np.repeat(np.arange(len(sizes)), per_doc)
        # Documents with most chunks first, so that the k-th chunks are a leading slice.
        self.order = np.argsort(-per_doc, kind="stable")
        self.depth = int(per_doc.max()) if len(sizes) else 0


def marginals(emission: np.ndarray, sizes: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginal of T of each token, log partition of each document, and with ``pairs`` the expected transitions.

    ``emission`` holds the documents' tokens one after another; ``trans`` is the 2 x 2 log transition matrix.
    """
    lay = Chunks(sizes)
    if lay.n == 0:
        return np.empty(0), np.zeros(len(sizes)), np.zeros((2, 2))
    psi = np.ones(lay.total * CHUNK)
    psi[lay.place] = np.exp(np.clip(emission, -40, 40))
    psi = psi.reshape(lay.total, CHUNK)
    a = np.exp(trans)

    def steps(c: int):
        """The four entries of each chunk's matrix at position ``c``; padding is the identity."""
        r, x = lay.real[:, c], psi[:, c]
        return np.where(r, a[0, 0], 1.0), np.where(r, a[0, 1] * x, 0.0), np.where(r, a[1, 0], 0.0), np.where(r, a[1, 1] * x, 1.0)

    # Transfer matrix of every chunk, scaled.
    r00, r01, r10, r11 = np.ones(lay.total), np.zeros(lay.total), np.zeros(lay.total), np.ones(lay.total)
    for c in range(CHUNK):
        m00, m01, m10, m11 = steps(c)
        r00, r01, r10, r11 = r00 * m00 + r01 * m10, r00 * m01 + r01 * m11, r10 * m00 + r11 * m10, r10 * m01 + r11 * m11
        s = 1 / np.maximum(np.maximum(r00, r01), np.maximum(r10, r11))
        r00, r01, r10, r11 = r00 * s, r01 * s, r10 * s, r11 * s
    # Forward vector before and backward vector after each chunk, chained by document.
    f0, f1 = np.ones(lay.total), np.zeros(lay.total)
    b0, b1 = np.ones(lay.total), np.ones(lay.total)
    counts = lay.per_doc[lay.order]
    for k in range(lay.depth - 1):
        docs = lay.order[: int(np.searchsorted(-counts, -(k + 1), side="left"))]
        i = lay.first[docs] + k
        x0, x1 = f0[i] * r00[i] + f1[i] * r10[i], f0[i] * r01[i] + f1[i] * r11[i]
        f0[i + 1], f1[i + 1] = x0 / (x0 + x1), x1 / (x0 + x1)
    for k in range(lay.depth - 2, -1, -1):
        docs = lay.order[: int(np.searchsorted(-counts, -(k + 1), side="left"))]
        i = lay.first[docs] + k
        j = i + 1
        x0, x1 = r00[j] * b0[j] + r01[j] * b1[j], r10[j] * b0[j] + r11[j] * b1[j]
        b0[i], b1[i] = x0 / (x0 + x1), x1 / (x0 + x1)
    # Inside the chunks.
    alpha = np.empty((CHUNK + 1, 2, lay.total))
    alpha[0] = f0, f1
    log_z = np.zeros(lay.total)
    for c in range(CHUNK):
        m00, m01, m10, m11 = steps(c)
        x0, x1 = alpha[c, 0] * m00 + alpha[c, 1] * m10, alpha[c, 0] * m01 + alpha[c, 1] * m11
        s = x0 + x1
        log_z += np.log(s)
        alpha[c + 1] = x0 / s, x1 / s
    out = np.empty((lay.total, CHUNK))
    moved = np.zeros((2, 2))
    for c in range(CHUNK - 1, -1, -1):
        x0, x1 = alpha[c + 1, 0] * b0, alpha[c + 1, 1] * b1
        out[:, c] = x1 / (x0 + x1)
        m00, m01, m10, m11 = steps(c)
        if pairs:
            p = np.stack([alpha[c, 0] * m00 * b0, alpha[c, 0] * m01 * b1, alpha[c, 1] * m10 * b0, alpha[c, 1] * m11 * b1])
            moved += (p / p.sum(axis=0) * lay.real[:, c]).sum(axis=1).reshape(2, 2)
        x0, x1 = m00 * b0 + m01 * b1, m10 * b0 + m11 * b1
        s = x0 + x1
        b0, b1 = x0 / s, x1 / s
    return out.ravel()[lay.place], np.bincount(lay.doc_of_chunk, log_z, minlength=len(sizes)), moved


def _prefixes(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in (4, 5, 6) if len(word) > k]]


def evidence_of(docs: list[list[str]], labels: list[int]) -> set[str]:
    """Words and prefixes that tell toxic documents, by the log-likelihood ratio of their distinct contexts."""
    often: Counter[str] = Counter()
    for words, label in zip(docs, labels, strict=True):
        if label:
            often.update(p for w in words for p in _prefixes(w))
    candidates = {p: k for k, p in enumerate(sorted(p for p, n in often.items() if n >= MIN_CONTEXTS))}
    del often
    mask = (1 << len(candidates).bit_length()) - 1
    distinct, tokens = [], [0, 0]
    for side in (0, 1):
        # A hash of the context with the candidate's number in its low bits: eight bytes an occurrence.
        keys = array("q")
        for words, label in zip(docs, labels, strict=True):
            if bool(label) != bool(side):
                continue
            tokens[side] += len(words)
            for i, w in enumerate(words):
                found = [candidates[p] for p in _prefixes(w) if p in candidates]
                if found:
                    context = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode("utf-8", "surrogatepass")
                    context = (xxhash.xxh64_intdigest(context) >> 1) & ~mask
                    keys.extend(context | k for k in found)
        distinct.append(np.bincount(np.unique(np.frombuffer(keys, np.int64)) & mask, minlength=len(candidates)) if keys else np.zeros(len(candidates), np.int64))
    base = tokens[1] / max(1, sum(tokens))
    out = set()
    for p, at in candidates.items():
        k = int(distinct[1][at])
        n = k + int(distinct[0][at])
        if k >= MIN_CONTEXTS and k >= MIN_SHARE * n:
            ratio = 2 * (k * math.log(k / (n * base)) + ((n - k) * math.log((n - k) / (n * (1 - base))) if n > k else 0.0))
            if ratio >= MIN_RATIO:
                out.add(p)
    return out


def tag_tokens(docs: list[list[str]], labels: list[int], evidence: set[str]) -> list[np.ndarray]:
    """T (1) or O (0) for each token of labelled documents."""
    return [np.array([bool(label) and any(p in evidence for p in _prefixes(w)) for w in words], float) for words, label in zip(docs, labels, strict=True)]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BINS))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Logistic unit over the aggregates: two weights and a bias; or a constant score.
    unit: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = 0.0

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0)
        return self.weights[np.array([features(w) for w in words])].sum(axis=1)


def aggregates(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By document: logit of the largest marginal, log of the expected number of T among tokens of at least ``SPAN_MARGINAL``.

    Tokens below it are left out, so that a long clean text does not add up to a toxic one.
    """
    out = np.full((len(sizes), 2), -8.0)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
        top = np.maximum.reduceat(p, starts)
        out[some, 0] = np.clip(np.log(top + 1e-12) - np.log1p(-top + 1e-12), -8, 8)
        out[some, 1] = np.clip(np.log(np.add.reduceat(np.where(p >= SPAN_MARGINAL, p, 0.0), starts) + 1e-12), -8, 8)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.02) -> np.ndarray:
    """Weights and bias by Newton steps with weight decay."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        keep = decay * np.array([1.0] * (len(w) - 1) + [0.01])
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag(keep + 1e-6)
        w = w - np.linalg.solve(h, x.T @ (q - y) + keep * w)
    return w


def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """Trains tags, field and document unit on whole texts with document labels 0 and 1."""
    if len(set(labels)) < 2:
        return Model(constant=float(labels[0]) if labels else 0.0)
    docs = [[w.lower() for w in _WORD.findall(t)] for t in texts]
    evidence = evidence_of(docs, labels)
    # The field itself learns from as many toxic documents as others.
    turn, chosen = [0, 0], []
    for i, label in enumerate(labels):
        turn[label] += 1
        if turn[label] <= PER_LABEL // 2:
            chosen.append(i)
    everything, all_labels = docs, labels
    docs, labels = [docs[i] for i in chosen], [labels[i] for i in chosen]
    tags = np.concatenate([np.empty(0), *tag_tokens(docs, labels, evidence)])
    sizes = np.array([len(d) for d in docs])
    vocabulary: dict[str, int] = {}
    ident = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d], np.int64)
    m = Model(constant=None)
    if not len(ident):
        m.unit = _logistic(aggregates(np.empty(0), sizes), np.array(labels, float))
        return m
    table_ = np.array([features(w) for w in vocabulary], np.int64)
    # Observed transitions, from O before each document.
    previous = np.concatenate([[0.0], tags[:-1]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    previous[starts[sizes > 0]] = 0.0
    observed = np.bincount((2 * previous + tags).astype(int), minlength=4).reshape(2, 2).astype(float)
    m.weights[features("")[2]] = -4.0
    m.trans[:] = [[0.0, 0.0], [0.0, 0.0]]
    scale = 1 / max(1.0, tags.sum())
    squares, squares_t = np.full(BINS, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        word_score = m.weights[table_].sum(axis=1)
        p, _, moved = marginals(word_score[ident], sizes, m.trans, pairs=True)
        by_word = np.bincount(ident, p - tags, minlength=len(vocabulary))
        grad = scale * np.bincount(table_.ravel(), np.repeat(by_word, table_.shape[1]), minlength=BINS) + DECAY * m.weights
        squares += grad**2
        m.weights -= RATE * grad / np.sqrt(squares)
        grad_t = scale * (moved - observed)
        grad_t[0, 0] = 0.0
        squares_t += grad_t**2
        m.trans -= 0.3 * RATE * grad_t / np.sqrt(squares_t)
    # The unit learns from all documents, at the labels' own frequencies.
    tagger, seen = Tagger(m), []
    for lo in range(0, len(everything), 200):
        part = everything[lo : lo + 200]
        part_sizes = np.array([len(d) for d in part], np.int64)
        seen.append(aggregates(marginals(tagger.emissions(part), part_sizes, m.trans)[0], part_sizes))
    m.unit = _logistic(np.concatenate(seen), np.array(all_labels, float))
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", modulus: int = 3, remainder: int = 1, per_label: int = PER_LABEL) -> Model:
    """A model from the labelled documents whose id is not held out."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    rows = rows.where(~held_out(F.col("id"), modulus, remainder))
    sample = labelled_sample(rows.where("label = 0"), CLEAN_TIMES * per_label) | labelled_sample(rows.where("label = 1"), per_label)
    got = texts_of(docs, [*sample], doc_id, text)
    return fit([t for _, t in got], [sample[i] for i, _ in got])


class Tagger:
    """Scores and spans of texts, with a bounded memory of word emissions."""

    def __init__(self, model: Model, cache: int = CACHE_WORDS):
        self.model, self.limit, self.known = model, cache, {}

    def emissions(self, docs: list[list[str]]) -> np.ndarray:
        new = set().union(*docs).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = set().union(*docs)
        new = [*new]
        self.known.update(zip(new, self.model.emissions(new).tolist(), strict=True))
        known = self.known
        return np.array([known[w] for d in docs for w in d])

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score and (start, end) code point spans of each text."""
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant), [[] for _ in texts]
        docs = [_WORD.findall(t) if t else [] for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        p, _, _ = marginals(self.emissions(docs), sizes, self.model.trans)
        x = aggregates(p, sizes)
        score = 1 / (1 + np.exp(-np.clip(x @ self.model.unit[:2] + self.model.unit[2], -30, 30)))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        hot = np.flatnonzero(p >= SPAN_MARGINAL)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        owner = np.searchsorted(starts, hot, side="right") - 1
        for d in np.unique(owner):
            wanted = set((hot[owner == d] - starts[d]).tolist())
            joined = -2
            for i, found in enumerate(_WORD.finditer(texts[d])):
                if i in wanted:
                    if joined == i - 1:
                        spans[d][-1] = (spans[d][-1][0], found.end())
                    else:
                        spans[d].append(found.span())
                    joined = i
        return score, spans


_TAGGERS: dict[str, Tagger] = {}


def score(docs: DataFrame, model: Model, text: str = "text", score_name: str = "toxicity_score", spans_name: str = "toxic_spans") -> DataFrame:
    """``docs`` with the score of every whole text and its toxic spans as code point offsets."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers
    key = uuid.uuid4().hex

    @F.pandas_udf("score double, spans array<struct<start: bigint, end: bigint>>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        if key not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[key] = Tagger(shared.value)
        values, scores, spans = texts.tolist(), [], []
        for lo, hi in batches_by_size(values, BATCH_CHARS):
            s, found = _TAGGERS[key].judge(values[lo:hi])
            scores.extend(s.tolist())
            spans.extend([{"start": a, "end": b} for a, b in x] for x in found)
        return pd.DataFrame({"score": np.array(scores, float), "spans": pd.Series(spans, dtype=object)})

    found = unused(docs, "judged")
    out = docs.withColumn(found, judged(F.col(text)))
    return out.withColumns({score_name: F.col(f"{found}.score"), spans_name: F.col(f"{found}.spans")}).drop(found)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), score_name="score", spans_name="spans")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
