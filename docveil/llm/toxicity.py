"""Toxicity: a counterfactually regularised logistic classifier over the distinct words of a text.

Features of a word are itself and its first 4, 5 and 6 letters, hashed; a text has a feature or not, however often and
however long the text is. Labelled texts are screened for features that go with either label, and the rest are fitted
by proximal gradients with an L1 penalty, so that a text of any length isn't moved by words that say nothing.

Counterfactuals: in labelled sentences that name a group, the name is swapped for others of its kind; the squared
change of the sentence's score is a penalty. Names of groups then weigh alike and, against the L1 penalty, nothing, so
neutral mentions aren't marked.

Learning: at most `sample_docs` labelled rows of at most `sample_bytes` together, drawn by the hash of their id, never
held-out ones; all sentences of their whole texts, each with all swaps. Scores read the whole text alone. Null and empty texts have the score of a text without features. Repeated rows give a row each;
columns other than the id and the text are not read. Without labels, every score is 0. Broadcast: the weights that
are not 0, no more than the sample's words have features.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, drawn, held_out, raw_column, table, within_bytes
from .pieces import Ids, kept

BITS = 22
#: Names of groups by kind; within a line, a name may stand for any other. Lower case, as word forms of four languages.
GROUPS = [
    "women men girls boys mothers fathers frauen männer mädchen jungen femmes hommes filles garçons mujeres hombres niñas niños",
    "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "black white asian african european latino arab schwarze weiße asiaten noirs blancs asiatiques negros blancos asiáticos",
    "gay lesbian straight bisexual transgender queer schwul lesbisch homosexuel lesbienne homosexual lesbiana",
    "immigrants refugees foreigners migrants natives einwanderer flüchtlinge ausländer immigrés réfugiés étrangers inmigrantes refugiados extranjeros",
    "disabled blind deaf elderly young poor behinderte blinde alte handicapés aveugles âgés discapacitados ciegos ancianos",
]
_KIND = {w: line.split() for line in GROUPS for w in line.split()}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def word_features(word: str) -> list[int]:
    names = ["w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


def features(text: str) -> set[int]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def swaps(text: str) -> Counter:
    """What each swap of a group's name in a sentence changes: (features that go, features that come), with their number."""
    out: Counter = Counter()
    for sentence in _SENTENCE.split(text):
        words = set(_WORD.findall(sentence.lower()))
        for name in words & _KIND.keys():
            rest = {f for w in words if w != name for f in word_features(w)}
            own = set(word_features(name)) - rest
            for other in _KIND[name]:
                if other != name:
                    new = set(word_features(other)) - rest
                    out[frozenset(own - new), frozenset(new - own)] += 1
    return out


class Model:
    """weights by feature; the score of a text is the logistic function of bias and the sum over its features."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights = bias, weights

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights.get(f, 0.0) for f in features(text)), -60, 60))))

    def active(self, pieces: list[bytes]) -> list[list[int]]:
        """The features with a weight of each piece; pieces are cut at white space, which no word spans."""
        return [sorted(f for f in features(p.decode("utf-8", "replace")) if f in self.weights) for p in pieces]


def _rows(sets: list, index: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    own = [[index[f] for f in s if f in index] for s in sets]
    return np.array([i for x in own for i in x], dtype=np.int64), np.repeat(np.arange(len(own)), [len(x) for x in own])


def learn(texts: list[str], labels: list[int], l1: float = 1e-3, fairness: float = 1.0, rounds: int = 300, least_docs: int = 4, z: float = 3.0) -> Model:
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(-60.0 if not len(y) or y.max() == 0 else 60.0, {})
    own = [np.fromiter(features(t), dtype=np.int32) for t in texts]
    flat, row = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(f) for f in own])
    del own
    names, at = np.unique(flat, return_inverse=True)
    n1, n0 = y.sum(), (1 - y).sum()
    c1 = np.bincount(at, y[row], minlength=len(names))
    c0 = np.bincount(at, 1 - y[row], minlength=len(names))
    odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
    error = np.sqrt(1 / (c1 + 0.5) + 1 / (n1 - c1 + 0.5) + 1 / (c0 + 0.5) + 1 / (n0 - c0 + 0.5))
    strength = np.abs(odds / error)
    changes = sum((swaps(t) for t in texts), Counter())
    pairs, times = list(changes), np.array(list(changes.values()), dtype=float)
    index = {int(f): i for i, f in enumerate(names[(c1 + c0 >= least_docs) & (strength >= z)])}
    for a, b in pairs:  # names of groups take part whatever their strength
        for f in a | b:
            index.setdefault(f, len(index))
    column = np.full(len(names), -1)
    for f, i in index.items():
        j = np.searchsorted(names, f)
        if j < len(names) and names[j] == f:
            column[j] = i
    x, r = column[at], row
    x, r = x[x >= 0], r[x >= 0]
    plus, p_row = _rows([a for a, _ in pairs], index)
    minus, m_row = _rows([b for _, b in pairs], index)
    k, n, n_pairs = len(index), len(y), len(pairs)
    share = times / times.sum() if n_pairs else times
    w, bias = np.zeros(k), float(np.log(n1 / n0))
    v, v_bias, step_t = w.copy(), bias, 1.0
    # one over a bound of the curvature: the traces of both quadratic forms
    rate = 1 / (0.25 * (1 + len(x) / n) + 2 * fairness * (share[p_row].sum() + share[m_row].sum()))
    for _ in range(rounds):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(r, v[x], minlength=n) + v_bias, -60, 60)))
        g = np.bincount(x, (score - y)[r], minlength=k) / n
        if pairs:
            change = share * (np.bincount(p_row, v[plus], minlength=n_pairs) - np.bincount(m_row, v[minus], minlength=n_pairs))
            g += 2 * fairness * (np.bincount(plus, change[p_row], minlength=k) - np.bincount(minus, change[m_row], minlength=k))
        new = v - rate * g
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * l1)
        new_bias = v_bias - rate * (score - y).mean()
        t = (1 + np.sqrt(1 + 4 * step_t * step_t)) / 2
        v, v_bias = new + (step_t - 1) / t * (new - w), new_bias + (step_t - 1) / t * (new_bias - bias)
        w, bias, step_t = new, new_bias, t
    return Model(float(bias), {f: float(w[i]) for f, i in index.items() if w[i] != 0})


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample_docs: int, doc_id: str, text: str, sample_bytes: int = 64 << 20) -> list:
    """(t, y, i) of at most sample_docs rows; the drawn ids are few enough to be sent everywhere. Of several texts with a
    drawn id, the one with the smallest hash is taken."""
    rated = labels.filter(~held_out(doc_id) & F.col(label).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).alias("y"))
    few = drawn(rated, sample_docs, "i", "y").distinct()
    own = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter("t is not null")
    one = own.join(F.broadcast(few), "i").groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = within_bytes(one.withColumn("o", F.xxhash64(F.col("i").cast("string"))), "t", sample_bytes, "o", "i", "y").select("t", "y", "i").collect()
    return sorted(rows, key=lambda r: (r["i"], r["t"], r["y"]))


def toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent, name = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights)), uuid.uuid4().hex

    def run(batches):
        m = Model(*sent.value)
        memo = kept(name, lambda: Ids(m.active))
        names = np.array(sorted(m.weights), dtype=np.int64)
        values = np.array([m.weights[i] for i in names.tolist()])
        for big in batches:
            for batch in by_bytes(big, "text", 2 << 20):
                words = [t.split() for t in raw_column(batch, "text")]
                ids, lens = memo.ids([w for x in words for w in x])
                of = np.repeat(np.repeat(np.arange(len(words)), [len(x) for x in words]), lens)
                seen = np.unique((of.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                logit = np.full(len(words), m.bias)
                if len(seen):
                    logit += np.bincount((seen >> np.uint64(32)).astype(np.int64), values[np.searchsorted(names, (seen & np.uint64(0xFFFFFFFF)).astype(np.int64))], minlength=len(words))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", doc_id)


def op7_toxicity(spark: SparkSession, sf_dir: str, sample_docs: int = 6000) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = labelled(docs, table(spark, sf_dir, "labels"), "toxic", sample_docs, "doc_id", "text")
    model = learn([r["t"] for r in rows], [r["y"] for r in rows])
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
