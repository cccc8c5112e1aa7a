"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word's vector is the mean of the vectors of its character n-grams and of itself, a
document's is the mean of all its words' vectors, and a linear softmax over it, scaled
by ``GAIN``, gives the probability. N-grams share rows of a hashed table, so that a word
never seen is near those it resembles. Embeddings and softmax are learned together.

The model is fitted on a bounded sample of labelled rows. Scoring covers whole texts: as
all is linear up to the softmax, each word has one number, and tasks look words up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batches_of

#: Labelled rows of each class that the model is fitted on at most, and their bytes of text in all.
SAMPLE, SAMPLE_BYTES = 2000, 256 << 20
BUCKETS, DIM, N_GRAMS = 1 << 18, 10, (3, 4, 5, 6)
#: Toxic words are few among all; the mean of a document is scaled up before the softmax.
GAIN = 100.0
EPOCHS, BATCH, RATE = 8, 64, 0.1
#: A small sample is gone through more often, until so many batches were seen.
LEAST_BATCHES = 100
#: Parts of the sample; each part's logits come from a model that has not seen it, and set the scale of the scores.
FOLDS = 5
#: Words whose numbers a task remembers; beyond, it starts anew.
REMEMBERED = 300_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def plain(word: str) -> str:
    """A word in lower case without ASCII marks at its ends, unless it has nothing else."""
    word = word.lower()
    return word.strip(EDGES) or word


def word_features(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of all words, and where each word's begin."""
    parts = [_features(words[s : s + at_once]) for s in range(0, len(words), at_once)]
    count = np.concatenate([np.zeros(1, np.int64), *(c for _, c in parts)])
    return np.concatenate([np.zeros(0, np.int32), *(r for r, _ in parts)]), np.cumsum(count)


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of some words, and their number for each word."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(start + length, length) - np.arange(len(code))
    rows, owners = [], []
    for n in N_GRAMS:
        acc = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(0x100000001B3) + code[k : k + len(acc)]
        fits = np.flatnonzero(left[: len(acc)] >= n)
        rows.append(acc[fits])
        owners.append(owner[fits])
    sums = np.concatenate([[0], np.cumsum(code * np.uint64(31) ** (np.uint64(1) + np.arange(len(code), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64)))]).astype(np.uint64)
    rows.append(sums[start + length] - sums[start] + np.uint64(7))
    owners.append(np.arange(len(words)))
    row, who = np.concatenate(rows), np.concatenate(owners)
    row = (row ^ (row >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(who, kind="stable")
    return ((row[order] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32), np.bincount(who, minlength=len(words))


@dataclass
class Model:
    """One number for each row of the n-gram table (its embedding along the softmax's direction), and the softmax's rest."""

    numbers: np.ndarray
    bias: float
    scale: float
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        rows, at = word_features(words)
        return np.add.reduceat(self.numbers[rows], at[:-1]) / np.diff(at)

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (logit + self.bias) + self.shift, -30, 30)))


def fit(texts: list[str], toxic: np.ndarray, seed: int = 3) -> Model:
    """Fits embeddings and softmax, classes weighing the same; the scores' scale is 1 and its shift 0."""
    if len(set(toxic.tolist())) < 2:
        only = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 3.0 if only > 0.5 else -3.0)
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(plain(w), len(number)) for w in t.split()], np.int32) for t in texts]
    rows, at = word_features(list(number))
    del number
    count = np.diff(at)
    table = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)).astype(np.float32) / DIM
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    soft[:, 1] = rng.normal(0, 0.1, DIM)
    sum_t, sum_s, sum_b = np.full(BUCKETS, 1e-6, np.float32), np.full_like(soft, 1e-6), np.full(2, 1e-6, np.float32)
    train = np.array([d for d in range(len(docs)) if len(docs[d])], np.int64)

    labels = toxic.astype(np.int64)
    ones = max(1, int(labels[train].sum()))
    weight = np.where(labels == 1, len(train) / (2 * ones), len(train) / (2 * max(1, len(train) - ones)))
    for _ in range(max(EPOCHS, -(-LEAST_BATCHES * BATCH // max(1, len(train))))):
        mixed = rng.permutation(train)
        for s in range(0, len(mixed), BATCH):
            some = mixed[s : s + BATCH]
            size = np.array([len(docs[d]) for d in some])
            ids, where = np.unique(np.concatenate([docs[d] for d in some]), return_inverse=True)
            of_doc = np.repeat(np.arange(len(some)), size)
            # how often each word is in each document, by its length
            cell, times = np.unique(of_doc * len(ids) + where, return_counts=True)
            cell_doc, cell_word = cell // len(ids), cell % len(ids)
            share = (GAIN * times / size[cell_doc]).astype(np.float32)
            picked = np.concatenate([rows[at[i] : at[i + 1]] for i in ids])
            begins = np.concatenate([[0], np.cumsum(count[ids])])[:-1]
            vectors = np.add.reduceat(table[picked], begins) / count[ids][:, None]
            first = np.searchsorted(cell_doc, np.arange(len(some)))
            means = np.add.reduceat(vectors[cell_word] * share[:, None], first)
            z = means @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            p *= (weight[some] / len(some))[:, None]
            to_means = p @ soft.T
            grad_soft, grad_bias = means.T @ p, p.sum(0)
            touched, inverse = np.unique(picked, return_inverse=True)
            grad = np.empty((len(touched), DIM), np.float32)
            spread = np.repeat(np.arange(len(ids)), count[ids])
            for k in range(DIM):
                to_words = np.bincount(cell_word, share * to_means[cell_doc, k], len(ids)) / count[ids]
                grad[:, k] = np.bincount(inverse, to_words[spread], len(touched))
            sum_s += grad_soft**2
            sum_b += grad_bias**2
            soft -= RATE * grad_soft / np.sqrt(sum_s)
            bias -= RATE * grad_bias / np.sqrt(sum_b)
            sum_t[touched] += (grad**2).mean(1)
            table[touched] -= RATE * grad / np.sqrt(sum_t[touched])[:, None]

    numbers = (GAIN * (table @ (soft[:, 1] - soft[:, 0]))).astype(np.float32)
    return Model(numbers, float(bias[1] - bias[0]), 1.0, 0.0)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits of rows that their models were not fitted on, by logistic regression in which classes weigh the same.

    So 0.5 is where a row is as likely among toxic as among clean ones, however rare the toxic
    are. Where the logits don't rise with the label the scale is 1, and the middle between
    the classes' means is at 0.5.
    """
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    even = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = even * p * (1 - p) + 1e-9
        g = np.array([(even * (p - y) * z).sum() + 0.01 * a, (even * (p - y)).sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, -float(z[y == 1].mean() + z[y == 0].mean()) / 2)


def _parts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their scores."""
    known: dict[str, float] = {}
    for part in batches_of(batches, "text", 500, 2 << 20):
        split = [(t or "").split() for t in part.column("text").to_pylist()]
        new = list({w for r in split for w in r if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known, new = {}, list({w for r in split for w in r})
        known.update(zip(new, model.words([plain(w) for w in new]).tolist(), strict=True))
        mean = np.array([np.fromiter(map(known.__getitem__, r), np.float64, len(r)).mean() if r else 0.0 for r in split])
        yield part, model.score(mean)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for part, score in _parts(batches, model.value):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    for part, score in _parts(batches, model.value):
        yield part.filter(pa.array(score < threshold))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 3, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled rows whose crc32 of the id is not 1 modulo 3, at most ``sample`` of each class.

    The sample is the same for the same rows; a text with which it would have more than
    ``sample_bytes`` is left out of it. Labels that are null are left
    out, a document with several labels is toxic if one says so, and of several rows of one
    doc_id the one with the least text counts. No labels, or those of one class alone, give
    a model that says the same of all. Scores are scaled on logits of models that have not
    seen the row, one for each of ``FOLDS`` parts of the sample, with both classes weighing
    the same, so that toxic documents are not missed for being rare.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    taken = None
    for value in (0, 1):
        some = known.where(F.col("toxic") == value).orderBy("draw", "doc_id").limit(sample)
        taken = some if taken is None else taken.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "draw").agg(F.max("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    # the sample has a fixed bound; a task fits one model, of all rows or of all but one part's, and the driver gets its numbers alone
    rows = rows.select("draw", "doc_id", "toxic", "text", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("part"))
    ordered = rows.repartitionByRange(FOLDS + 1, "part").sortWithinPartitions("part", "draw", "doc_id").select("part", "toxic", "text")
    fitted = {r["part"]: r for r in ordered.mapInArrow(lambda it: _fit_sample(it, seed, sample_bytes), FITTED).collect()}
    if not fitted:
        return fit([], np.zeros(0, np.int64), seed)
    whole = fitted[FOLDS]
    model = Model(np.frombuffer(whole["numbers"], np.float32), whole["bias"], whole["scale"], whole["shift"])
    if model.scale:
        parts = [fitted[k] for k in range(FOLDS)]
        model.scale, model.shift = calibrate(np.concatenate([p["logits"] for p in parts]), np.concatenate([p["toxic"] for p in parts]).astype(np.int64))
    return model


FITTED = "part int, numbers binary, bias double, scale double, shift double, logits array<double>, toxic array<int>"


def logits(model: Model, texts: list[str]) -> list[float]:
    split = [t.split() for t in texts]
    known = list({w for r in split for w in r})
    number = dict(zip(known, model.words([plain(w) for w in known]).tolist(), strict=True))
    return [model.bias + (float(np.mean([number[w] for w in r])) if r else 0.0) for r in split]


def _fit_sample(batches: Iterator[pa.RecordBatch], seed: int, most: int) -> Iterator[pa.RecordBatch]:
    """For each part the sample's rows come for, one after another, a row with its model and the logits of the part."""
    part, texts, toxic, size = None, [], [], 0
    for batch in batches:
        for own, text, value in zip(*(batch.column(c).to_pylist() for c in ("part", "text", "toxic")), strict=True):
            if own != part and part is not None:
                yield _fitted(part, texts, toxic, seed)
                texts, toxic, size = [], [], 0
            part, length = own, len((text or "").encode())
            if size + length <= most:
                size += length
                texts.append(text or "")
                toxic.append(value)
    if part is not None:
        yield _fitted(part, texts, toxic, seed)


def _fitted(part: int, texts: list[str], toxic: list[int], seed: int) -> pa.RecordBatch:
    y, seen = np.array(toxic, np.int64), np.ones(len(toxic), bool)
    for value in (0, 1):  # parts have as much of each class
        own = np.flatnonzero(y == value)
        seen[own] = np.arange(len(own)) % FOLDS != part
    m = fit([t for t, s in zip(texts, seen, strict=True) if s], y[seen], seed)
    z = logits(m, [t for t, s in zip(texts, seen, strict=True) if not s])
    cells = [part, m.numbers.astype(np.float32).tobytes() if part == FOLDS else b"", m.bias, m.scale, m.shift, z, y[~seen].tolist()]
    kinds = [pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[f.split()[0] for f in FITTED.split(", ")])


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score from 0 to 1 and predicted (1 if the score is the threshold or more) of every row.

    Only the text decides. Null and empty texts have the score of a mean of zero. Repeated rows
    come back as often as they are there. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    scored = rows.mapInArrow(lambda it: _score(it, sent), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _keep(it, sent, threshold), docs.schema)
