"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold_j - w . x) with ordered thresholds and one weight vector for all of them. A text's
vector x holds hashed features: the shares of word shapes (letters, digits, signs and their runs) and of signs at word
ends, and bands of a few whole-text measures (distinct words, word length, letters, lines that repeat). From the
thresholds follow the expected grade and the tail probability P(grade >= good_grade), which selects.

Learning: at most `sample_docs` rated rows of at most `sample_bytes` together, drawn by the hash of their id, never held-out
ones; whole texts. Grades are
the distinct ratings in ascending order. Null and empty texts are rated by their features like any other. Repeated
rows give a row each; columns other than the id and the text are not read. Without ratings, the expected grade is null
and every tail probability 0. Broadcast: 2 ** BITS weights.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, held_out, table
from .pieces import Ids, kept, sums
from .toxicity import labelled

BITS = 14
_CLASSES = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9")]


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def word_facts(pieces: list[bytes]) -> list[list[int]]:
    """Of each word: its shape's feature, its ending's feature, its number of characters and of letters."""
    out = []
    for p in pieces:
        w = p.decode("utf-8", "replace")
        shape = w
        for pattern, mark in _CLASSES:
            shape = pattern.sub(mark, shape)
        letters = sum(map(str.isalpha, w))
        case = "U" if w.isupper() and len(w) > 1 else "T" if w[:1].isupper() else "l"
        out.append([_hash("shape" + case + shape), _hash("end" + re.sub(r"[\w]+", "", w[-3:])), len(w), letters])
    return out


def vectors(memo: Ids, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: text, feature, value."""
    words = [t.split() for t in texts]
    lens = np.array([len(w) for w in words], dtype=np.int64)
    flat = [x for w in words for x in w]
    at = memo.look_up(flat)  # equal words have equal numbers
    facts = np.array(memo.flat, dtype=np.int64).reshape(-1, 4)[at]
    of = np.repeat(np.arange(len(texts)), lens)
    n = np.maximum(lens, 1)
    row, feature, value = [of, of], [facts[:, 0], facts[:, 1]], [1 / n[of], 1 / n[of]]
    if len(flat):
        span = len(memo) + 1
        distinct = np.bincount(np.unique(of * span + at) // span, minlength=len(texts))
        new = np.diff(at, prepend=-1) != 0
        new[(np.cumsum(lens) - lens)[lens > 0]] = True
        again = lens - sums(new, lens)
    else:
        distinct = again = np.zeros(len(texts), dtype=np.int64)
    chars, letters = sums(facts[:, 2], lens), sums(facts[:, 3], lens)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    copied = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    size = np.log2(lens + 1).astype(np.int64)
    measures = {
        "distinct": distinct / n, "length": np.minimum(chars / n / 20, 1), "letters": letters / np.maximum(chars, 1), "again": again / n, "lines": copied,
    }
    for name, m in measures.items():
        band = np.minimum((m * 20).astype(np.int64), 20)
        own = [[_hash(f"{name}{b}") for b in band.tolist()]]
        if name == "distinct":  # falls with the length of a text
            own.append([_hash(f"{name}{b}|{s}") for b, s in zip(band.tolist(), size.tolist(), strict=True)])
        for h in own:
            row.append(np.arange(len(texts)))
            feature.append(np.array(h, dtype=np.int64))
            value.append(np.ones(len(texts)))
    row.append(np.arange(len(texts)))
    feature.append(np.array([_hash(f"size{s}") for s in size.tolist()], dtype=np.int64))
    value.append(np.ones(len(texts)))
    return np.concatenate(row), np.concatenate(feature), np.concatenate(value)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """grades ascending; thresholds between them; weights by feature."""

    def __init__(self, grades: list, thresholds: np.ndarray, weights: np.ndarray):
        self.grades, self.thresholds, self.weights = grades, thresholds, weights

    def probabilities(self, memo: Ids, texts: list[bytes]) -> np.ndarray:
        """P(grade) of each text, a column for each grade."""
        row, feature, value = vectors(memo, texts)
        x = np.bincount(row, self.weights[feature] * value, minlength=len(texts))
        below = _logistic(self.thresholds[None, :] - x[:, None])
        edge = np.ones((len(texts), 1))
        return np.diff(np.hstack([0 * edge, below, edge]), axis=1)


def learn(texts: list[bytes], ratings: list, rounds: int = 400, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Adagrad on the log-likelihood; thresholds are a first one and the exponentials of their gaps."""
    grades = sorted(set(ratings))
    k = len(grades) - 1
    weights = np.zeros(1 << BITS)
    if k < 1:
        return Model(grades, np.zeros(0), weights)
    y = np.array([grades.index(r) for r in ratings])
    memo, parts = Ids(word_facts, code="i", most=200_000), []
    for i in range(0, len(texts), 100):  # each text's equal features in one, before the next ones are read
        row, feature, value = vectors(memo, texts[i : i + 100])
        key, at = np.unique(row * (1 << BITS) + feature, return_inverse=True)
        parts.append(((key >> BITS) + i, key & ((1 << BITS) - 1), np.bincount(at, value)))
    del memo
    row, feature, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = len(y)
    share = np.clip([(y <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(raw, 1e-8)
    for _ in range(rounds):
        thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        x = np.bincount(row, weights[feature] * value, minlength=n)
        upper = np.where(y < k, _logistic(thresholds[np.minimum(y, k - 1)] - x), 1.0)
        lower = np.where(y > 0, _logistic(thresholds[np.maximum(y, 1) - 1] - x), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_x = d_low - d_up
        g_w = np.bincount(feature, g_x[row] * value, minlength=1 << BITS) / n - decay * weights
        g_th = (np.bincount(np.minimum(y, k - 1), d_up * (y < k), minlength=k) - np.bincount(np.maximum(y, 1) - 1, d_low * (y > 0), minlength=k)) / n
        after = np.cumsum(g_th[::-1])[::-1]  # a raw value moves its own threshold and all above
        g_raw = np.concatenate([after[:1], after[1:] * np.exp(raw[1:])])
        seen_w += g_w * g_w
        seen_t += g_raw * g_raw
        weights += rate * g_w / np.sqrt(seen_w)
        raw += rate * g_raw / np.sqrt(seen_t)
    return Model(grades, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])), weights)


def quality(docs: DataFrame, model: Model, good_grade=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, with expected_grade and tail_prob (columns of these names are replaced); good_grade: the highest by default."""
    grades = model.grades
    good = (grades[-1] if good_grade is None else good_grade) if grades else None
    base, name = docs.drop("expected_grade", "tail_prob"), uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((grades, model.thresholds, model.weights))

    def make():
        m = Model(*sent.value)
        memo = kept("word facts", lambda: Ids(word_facts, code="i", most=400_000))

        def of(texts):
            if m.grades:
                p = m.probabilities(memo, texts)
                expected, tail = p @ np.array(m.grades, dtype=float), p[:, [g >= good for g in m.grades]].sum(1)
            else:
                expected, tail = np.full(len(texts), np.nan), np.zeros(len(texts))
            return [pa.array(expected, pa.float64(), from_pandas=True), pa.array(tail, pa.float64())]

        return of

    out = base.select("*", by_text(make, "expected_grade double, tail_prob double", 1 << 20)(F.col(text)).alias(name))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.col(name)["expected_grade"].alias("expected_grade"), F.col(name)["tail_prob"].alias("tail_prob"))


def trained(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, sample_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", rating: str = "quality") -> Model:
    rows = labelled(docs, labels, rating, sample_docs, doc_id, text, sample_bytes)
    return learn([r["t"].encode("utf-8", "surrogatepass") for r in rows], [r["y"] for r in rows])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= 0.5).alias("selected"))
