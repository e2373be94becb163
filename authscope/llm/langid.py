"""Language identification by a linear-chain conditional random field over words.

Every word has emission scores from affixes, character n-grams and a lexicon of frequent words; transitions
between the languages of neighbouring words are learned, so that code-switched text is labelled word by word.
Labels come from forward-backward: a document's language is the one with the largest mean posterior.

The chain runs over whole texts of any length. It is cut into blocks; each block's transfer matrix is computed
for all blocks of a batch at once, blocks are then chained for each document, and the posteriors inside follow.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authscope.llm.common import in_arrow, picked, slices

_WORD = re.compile(r"[^\W\d_]+")
_BITS, _BLOCK, REMEMBERED = 15, 32, 400_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Training:
    """rows_per_language: rows of the training sample for each label at most, drawn by hash of the row; languages: labels
    that are learned at most, the most frequent ones; chars_per_row: characters of a stretch that reaches the driver of
    each row; words_per_row: words of it that are learned from; lexicon: frequent words per language that get a weight;
    sequences: spliced sequences at most that the chain is fitted on."""

    rows_per_language: int = 300
    languages: int = 256
    chars_per_row: int = 4000
    words_per_row: int = 400
    sequences: int = 4000
    lexicon: int = 2000
    sequence: int = 48
    epochs: int = 4
    rate: float = 0.05
    seed: int = 11


def words(text: str | None) -> list[str]:
    """Runs of letters, lower case, composed; empty if the text is null or has no letter."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    found = _WORD.findall(text)
    if not all(map(str.isalpha, found)):  # number letters such as fractions aren't letters
        found = [w for w in found if any(map(str.isalpha, w))]
    return found or [c for c in text if c.isalpha()]


def features(vocabulary: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) pairs: n-grams of 1 to 3 characters with word edges, prefixes and suffixes of
    up to 3, and the word itself if it is in the lexicon. Features are hashed but for the lexicon's."""
    if not vocabulary:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "".join(f"\x02{w}\x03" for w in vocabulary)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in vocabulary])
    word = np.repeat(np.arange(len(vocabulary)), lengths)
    ends = np.cumsum(lengths)
    at = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)  # place in the word
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters to its end
    pad = np.concatenate([codes, np.zeros(4, np.uint64)])
    which, number, grams = [], [], codes * _MUL
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if n > 1:
                grams = (grams ^ (grams >> np.uint64(29))) * _MUL + pad[n - 1 : n - 1 + len(codes)] * np.uint64(0xBF58476D1CE4E5B9)
            inside = left >= n
            kinds = [(0, inside & (n <= 3)), (1, inside & (at == 0) & (n > 1)), (2, inside & (left == n) & (n > 1))]
            for kind, mask in kinds:
                h = (grams[mask] + np.uint64(977 * n + 31 * kind)) * _MUL
                which.append(word[mask])
                number.append((h >> np.uint64(64 - _BITS)).astype(np.int64))
    known = [(i, lexicon[w]) for i, w in enumerate(vocabulary) if w in lexicon]
    if known:
        i, f = zip(*known, strict=True)
        which.append(np.array(i))
        number.append(np.array(f) + (1 << _BITS))
    return np.concatenate(which), np.concatenate(number)


def emissions(vocabulary: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """Scores of every word for every label."""
    which, number = features(vocabulary, lexicon)
    return np.stack([np.bincount(which, w[number], len(vocabulary)) for w in weights.T], axis=1)


def posteriors(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label posteriors of every word. scores: (words, labels) of all documents in a row, starts: first word of each
    (none is empty). The state before the first word is uniform, and every step takes a transition."""
    n, labels = scores.shape
    lengths = np.diff(starts, append=n)
    per = -(-lengths // _BLOCK)  # blocks of each document
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    total = int(per.sum())
    of = np.repeat(np.arange(len(starts)), per)
    begin = starts[of] + (np.arange(total) - first[of]) * _BLOCK
    size = np.minimum(_BLOCK, starts[of] + lengths[of] - begin)
    at = np.minimum(begin[:, None] + np.arange(_BLOCK), n - 1)
    live = np.arange(_BLOCK) < size[:, None]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))[at]
    trans = np.exp(transitions)
    step = lambda t: np.where(live[:, t, None, None], trans[None] * e[:, t, None, :], np.eye(labels))
    move = np.broadcast_to(np.eye(labels), (total, labels, labels))
    for t in range(_BLOCK):
        move = move @ step(t)
        if t % 8 == 7:  # often enough against underflow
            move /= move.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.full((total, labels), 1.0 / labels), np.ones((total, labels))
    for k in range(1, int(per.max(initial=0))):  # documents with more than k blocks
        b = first[per > k] + k
        a = np.einsum("di,dij->dj", ahead[b - 1], move[b - 1])
        ahead[b] = a / a.sum(axis=1, keepdims=True)
        last = (first + per - 1)[per > k] - k
        z = np.einsum("dij,dj->di", move[last + 1], behind[last + 1])
        behind[last] = z / z.max(axis=1, keepdims=True)
    forward = np.empty((total, _BLOCK, labels))
    a = ahead
    for t in range(_BLOCK):
        a = np.where(live[:, t, None], (a @ trans) * e[:, t], a)
        if t % 8 == 7:
            a /= a.sum(axis=1, keepdims=True)
        forward[:, t] = a
    z = behind
    for t in reversed(range(_BLOCK)):
        forward[:, t] *= z
        z = np.where(live[:, t, None], (e[:, t] * z) @ trans.T, z)
        if t % 8 == 7:
            z /= z.max(axis=1, keepdims=True)
    out = forward[live]
    return out / out.sum(axis=1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]
    known: dict[str, int] = field(default_factory=dict)  # words met before in this process, and their scores
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def word_scores(self, flat: list[str]) -> np.ndarray:
        """Emission scores of the words; those of words met before are remembered, up to REMEMBERED words."""
        if len(self.known) > REMEMBERED or not self.known:
            self.known, self.scores = {}, np.zeros((0, len(self.labels)))
        known, old = self.known, len(self.known)
        new = sorted(set(flat).difference(known))
        known.update(zip(new, range(old, old + len(new)), strict=True))
        index = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        if new:
            if len(known) > len(self.scores):
                self.scores = np.concatenate([self.scores[:old], np.zeros((max(len(known), 2 * old) - old, len(self.labels)))])
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.scores[old + i : old + i + len(part)] = emissions(part, self.weights, self.lexicon)
        return self.scores[index]

    def label_words(self, documents: list[list[str]]) -> list[np.ndarray]:
        """Posteriors (words, labels) of each document's words."""
        starts, flat = [], []
        for d in documents:
            starts.append(len(flat))
            flat += d
        if not flat:
            return [np.zeros((0, len(self.labels))) for _ in documents]
        scores = self.word_scores(flat)
        full = np.array([s for s, d in zip(starts, documents, strict=True) if d])
        found = posteriors(scores, full, self.transitions)
        ends = [*starts[1:], len(flat)]
        return [found[a:b] for a, b in zip(starts, ends, strict=True)]

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean posterior) of every whole text; `und` and 0 without a letter."""
        out = []
        for p in self.label_words([words(t) for t in texts]):
            mean = p.mean(axis=0) if len(p) else None
            out.append((self.labels[int(mean.argmax())], min(1.0, float(mean.max()))) if mean is not None else ("und", 0.0))
        return out


def fit(rows: list[tuple[str, str]], p: Training = Training()) -> Model:
    """A model from (text, language) rows. Sequences are spliced from stretches of different documents, so that
    transitions are learned from text that switches; half of them stay in one language."""
    rng = np.random.default_rng(p.seed)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    labels = sorted({r[1] for r in rows})
    own = [[] for _ in labels]
    for text, lang in rows:
        found = words(text)
        skip = int(rng.integers(max(1, len(found) - p.words_per_row + 1)))
        own[labels.index(lang)] += found[skip : skip + p.words_per_row]
    frequent = sorted({w for ws in own for w, _ in Counter(ws).most_common(p.lexicon)})
    lexicon = {w: i for i, w in enumerate(frequent)}
    weights, transitions = np.zeros(((1 << _BITS) + len(lexicon), len(labels))), np.zeros((len(labels), len(labels)))
    usable = [k for k, ws in enumerate(own) if ws]
    if len(labels) < 2 or not usable:
        return Model(labels, weights, transitions, lexicon)
    n = min(p.sequences, max(200, sum(map(len, own)) // p.sequence))
    sequences, truth = [], []
    for s in range(n):
        seq, lab = [], []
        while len(seq) < p.sequence:
            k = int(rng.choice(usable)) if s % 2 and seq or not seq else lab[-1]
            length = int(rng.integers(4, 20))
            at = int(rng.integers(max(1, len(own[k]) - length)))
            seq += own[k][at : at + length]
            lab += [k] * len(own[k][at : at + length])
        sequences.append(seq[: p.sequence])
        truth.append(lab[: p.sequence])
    number: dict[str, int] = {}
    index = np.array([[number.setdefault(w, len(number)) for w in s] for s in sequences])
    truth = np.array(truth)
    which, feature = features(list(number), lexicon)
    order = np.argsort(which, kind="stable")
    which, feature = which[order], feature[order]
    bounds = np.searchsorted(which, np.arange(len(number) + 1))
    square_w, square_t, size = np.zeros_like(weights), np.zeros_like(transitions), 64
    for _ in range(p.epochs):
        turn = rng.permutation(n)
        for i in range(0, n, size):
            some = turn[i : i + size]
            used, back = np.unique(index[some].ravel(), return_inverse=True)
            span = np.concatenate([np.arange(bounds[u], bounds[u + 1]) for u in used])
            local = np.repeat(np.arange(len(used)), bounds[used + 1] - bounds[used])
            f = feature[span]
            scores = np.stack([np.bincount(local, w[f], len(used)) for w in weights.T], axis=1)[back].reshape(len(some), p.sequence, -1)
            gw, gt = _gradient(scores, transitions, truth[some])
            per_word = np.stack([np.bincount(back, g, len(used)) for g in gw.reshape(-1, len(labels)).T], axis=1)
            grad = np.stack([np.bincount(f, g[local], len(weights)) for g in per_word.T], axis=1) / len(some) - 1e-4 * weights
            square_w += grad * grad
            weights += p.rate * grad / (np.sqrt(square_w) + 1e-8)
            gt = gt / len(some) - 1e-4 * transitions
            square_t += gt * gt
            transitions += p.rate * gt / (np.sqrt(square_t) + 1e-8)
    return Model(labels, weights, transitions, lexicon)


def _gradient(scores: np.ndarray, transitions: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood for scores and transitions; forward-backward over sequences of one length."""
    s, t, labels = scores.shape
    e, trans = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(transitions)
    forward, backward = np.empty((t, s, labels)), np.empty((t, s, labels))
    a = np.full((s, labels), 1.0 / labels)
    for k in range(t):
        a = (a @ trans) * e[:, k]
        a /= a.sum(axis=1, keepdims=True)
        forward[k] = a
    z = np.ones((s, labels))
    for k in reversed(range(t)):
        backward[k] = z
        z = (e[:, k] * z) @ trans.T
        z /= z.max(axis=1, keepdims=True)
    post = forward * backward
    post /= post.sum(axis=2, keepdims=True)
    hot = np.eye(labels)[truth]
    gt = np.zeros_like(transitions)
    for k in range(1, t):
        pair = forward[k - 1][:, :, None] * trans[None] * (e[:, k] * backward[k])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        gt -= pair.sum(axis=0)
        gt += hot[:, k - 1].T @ hot[:, k]
    return hot - post.transpose(1, 0, 2), gt


def training_rows(train: DataFrame, text: str, lang: str, key: str, p: Training) -> list[tuple[str, str]]:
    """The bounded sample of (text, language): for each label, the rows_per_language rows with the smallest hash.

    The hash is of key and whole text, so that rows that share a key are drawn apart; rows equal in both stand for
    each other. Each row is a stretch of chars_per_row characters, cut where it lies.
    """
    rows = picked(train, key=key, text=text, lang=lang).filter("text is not null and lang is not null")
    known = F.broadcast(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.languages))
    place = F.xxhash64(F.lit(p.seed), F.col("key").cast("string"), "text")
    start = F.pmod(F.col("place"), F.greatest(F.length("text") - p.chars_per_row + 1, F.lit(1))) + 1
    # the smallest hashes are surely among four times as many as are wanted; equal rows meet before any is moved
    some = rows.withColumn("place", place).join(known, "lang").filter(F.pmod("place", F.lit(10**9)) * F.col("count") < 4 * p.rows_per_language * 10**9)
    cut = some.select("lang", "place", F.substring("text", start.cast("int"), F.lit(p.chars_per_row)).alias("text")).groupBy("lang", "place").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(10**9)), "place"))
    drawn = cut.withColumn("n", first).filter(F.col("n") <= p.rows_per_language)
    return [(r["text"], r["lang"]) for r in drawn.select("text", "lang").collect()]


def identify(docs: DataFrame, train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", p: Training = Training()) -> DataFrame:
    """key, lang_pred and score for every row of docs; learned from text and non-null lang of train only.

    Null text, or text without a letter: `und` with score 0; so is everything if train has no label. Rows stay as
    they are, repeated ones too. Empty table: empty result. Texts are labelled whole; other columns are ignored,
    whatever they are called.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(training_rows(train, text, lang, key, p), p))
    rows = picked(docs, doc_key=key, body=text)
    schema = T.StructType([rows.schema["doc_key"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            found = model.value.identify(texts) if model.value.labels else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return in_arrow(rows, run, schema).toDF(key, "lang_pred", "score")
