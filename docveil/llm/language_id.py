"""Language ID by a linear-chain conditional random field over words.

Every word has a language; a word's features are its affixes, its character trigrams and itself (the lexicon), hashed;
neighbouring words are tied by learned transitions, so words of a code-switched text are labelled in runs. A text's
language is the one with the largest mean of the words' marginals (forward-backward), its score that mean.

Words are cut at ASCII white space; one of more than LONGEST letters, as of scripts without spaces, takes several places
in the chain, each of LONGEST letters and beginning with the last two of the place before, so that every letter and every
trigram is read. Such places are labelled like words, so a switch of language within a long run is seen.

Learning: the conditional likelihood of every word's language, by gradients from the same forward-backward, on at most
`sample_docs` labelled documents of at most `sample_bytes` together, drawn by the hash of their id and text. A document's
words have its language; sequences spliced from two documents of different languages (splices()) show where languages
switch. Predictions read the text alone, whole: long texts are cut into segments whose transfer matrices are chained, which
is exact. word_labels() gives the language of each word of a text, spans() its runs.

Null texts and texts without a letter are `und` with score 0, and so is everything if no label is given. Repeated rows
give a row each; extra columns are ignored. Broadcast: the weights, (2 ** BITS) x languages.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, drawn, held_out, spread, table, within_bytes
from .pieces import Ids, kept, sums

BITS, SEGMENT, LONGEST = 16, 64, 40
_LONG = re.compile(rb"[^\x20\x09-\x0D]{%d}" % (LONGEST + 1))


def letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def chain_words(text: bytes) -> list[bytes]:
    """The words of a text; those of more than LONGEST letters as runs of LONGEST that share two letters with the next."""
    words = text.split()
    if not _LONG.search(text):
        return words
    out = []
    for word in words:
        own = letters(word.decode("utf-8", "replace")) if len(word) > LONGEST else ""
        if len(own) > LONGEST:
            out += [own[i : i + LONGEST].encode("utf-8") for i in range(0, len(own) - 2, LONGEST - 2)]
        else:
            out.append(word)
    return out


def word_features(word: str) -> list[int]:
    """Hashed features of the word's letters, of which chain_words() leaves at most LONGEST; none if it has no letter."""
    w = letters(word)
    if not w:
        return []
    edged = f"^{w}$"
    names = ["w" + w, *(f"p{w[:n]}" for n in (1, 2, 3)), *(f"s{w[-n:]}" for n in (1, 2, 3)), *(edged[i : i + 3] for i in range(len(edged) - 2))]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


class Chain:
    """Forward-backward over many texts at once; emissions are log scores of every word, lens the texts' words."""

    def __init__(self, emissions: np.ndarray, lens: np.ndarray, transitions: np.ndarray):
        n_labels = emissions.shape[1]
        self.lens, self.t = lens, np.exp(transitions - transitions.max())
        n_seg = -(-lens // SEGMENT)
        total = int(n_seg.sum())
        self.seg_first = np.cumsum(n_seg) - n_seg
        # where each word stands: its segment and place
        within = spread(np.zeros(len(lens), np.int64), lens)
        self.seg = np.repeat(self.seg_first, lens) + within // SEGMENT
        self.at = within % SEGMENT
        e = np.ones((SEGMENT, total, n_labels))
        e[self.at, self.seg] = np.exp(emissions - emissions.max(1, keepdims=True))
        self.e = e
        self.real = np.zeros((SEGMENT, total), dtype=bool)
        self.real[self.at, self.seg] = True
        self.n_seg, self.total, self.n_labels = n_seg, total, n_labels

    def marginals(self) -> np.ndarray:
        """A row per word."""
        k, t, e = self.n_labels, self.t, self.e
        m = np.broadcast_to(np.eye(k), (self.total, k, k)).copy()
        for s in range(SEGMENT):
            real = self.real[s]
            if not real.any():
                break
            step = (m.reshape(-1, k) @ t).reshape(-1, k, k) * e[s][:, None, :]
            step /= step.sum((1, 2), keepdims=True)
            m = step if real.all() else np.where(real[:, None, None], step, m)
        into, out = np.full((self.total, k), 1.0 / k), np.full((self.total, k), 1.0 / k)
        order = np.argsort(-self.n_seg, kind="stable")
        sizes = self.n_seg[order]
        for s in range(1, int(sizes[0]) if len(sizes) else 0):
            at = self.seg_first[order[: np.searchsorted(-sizes, -s, side="left")]] + s
            a = np.einsum("ni,nij->nj", into[at - 1], m[at - 1])
            into[at] = a / a.sum(1, keepdims=True)
        for s in range((int(sizes[0]) if len(sizes) else 0) - 1, 0, -1):
            at = self.seg_first[order[: np.searchsorted(-sizes, -s, side="left")]] + s
            b = np.einsum("nij,nj->ni", m[at], out[at])
            out[at - 1] = b / b.sum(1, keepdims=True)
        self.before = np.empty((SEGMENT, self.total, k))  # forward, before each word's own step
        self.forward = np.empty_like(self.before)
        a = into
        for s in range(SEGMENT):
            self.before[s] = a
            step = (a @ t) * e[s]
            step /= step.sum(1, keepdims=True)
            a = np.where(self.real[s][:, None], step, a)
            self.forward[s] = a
        self.backward = np.empty_like(self.before)
        b = out
        for s in range(SEGMENT - 1, -1, -1):
            self.backward[s] = b
            step = (e[s] * b) @ t.T
            step /= step.sum(1, keepdims=True)
            b = np.where(self.real[s][:, None], step, b)
        p = (self.forward * self.backward)[self.at, self.seg]
        return p / p.sum(1, keepdims=True)

    def pairs(self) -> np.ndarray:
        """Expected number of each transition, after marginals()."""
        k = self.n_labels
        out = np.zeros((k, k))
        for s in range(SEGMENT):
            own = self.real[s] if s else self.real[s] & ~np.isin(np.arange(self.total), self.seg_first)
            x = self.before[s][own][:, :, None] * self.t[None] * (self.e[s][own] * self.backward[s][own])[:, None, :]
            out += (x / x.sum((1, 2), keepdims=True)).sum(0)
        return out


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions

    def emissions(self, words: list[bytes]) -> list[list[float]]:
        """Of each word: a score per label, then 1 if it has a letter."""
        features = [word_features(w.decode("utf-8", "replace")) for w in words]
        lens = np.array([len(f) for f in features], dtype=np.int64)
        flat = np.array([i for f in features for i in f], dtype=np.int64)
        rows = np.stack([sums(self.weights[flat, j], lens) for j in range(len(self.labels))] + [np.minimum(lens, 1)], axis=1)
        return rows.tolist()

    def scores(self, memo: Ids, texts: list[bytes]) -> np.ndarray:
        """Means of the marginals of words with letters, a row per text; zeros if there is none."""
        words = [chain_words(t) for t in texts]
        lens = np.array([len(w) for w in words], dtype=np.int64)
        values, _ = memo.ids([x for w in words for x in w])
        values = values.reshape(-1, len(self.labels) + 1)
        lettered = values[:, -1] > 0
        has = sums(lettered, lens)
        own = np.flatnonzero(lens)
        if not len(own):
            return np.zeros((len(texts), len(self.labels)))
        p = Chain(values[:, :-1], lens[own], self.transitions).marginals() * lettered[:, None]
        out = np.stack([sums(p[:, j], lens) for j in range(p.shape[1])], axis=1)
        return np.clip(out / np.maximum(has, 1)[:, None], 0, 1) * (has > 0)[:, None]

    def word_labels(self, text: bytes) -> list[tuple[str, str]]:
        """Each place of the chain (a word, see chain_words) with its likeliest language; `und` without a letter."""
        words = chain_words(text)
        if not words or not self.labels:
            return [(w.decode("utf-8", "replace"), "und") for w in words]
        values = np.array(self.emissions(words))
        best = Chain(values[:, :-1], np.array([len(words)]), self.transitions).marginals().argmax(1)
        return [(w.decode("utf-8", "replace"), self.labels[i] if x else "und") for w, i, x in zip(words, best.tolist(), values[:, -1].tolist(), strict=True)]


SPLICED, EVERY = 12, 4


def splices(words: list[list[bytes]], langs: list[str]) -> list[tuple[list[bytes], list[str]]]:
    """For every EVERY-th text, a sequence of it and the next one of another language, SPLICED words of each by turns."""
    out, n = [], len(words)
    for i in range(0, n, EVERY):
        j = next((j % n for j in range(i + 1, i + n) if langs[j % n] != langs[i]), None)
        if j is None:
            break
        own: list[bytes] = []
        gold: list[str] = []
        for a in range(0, 3 * SPLICED, SPLICED):
            for k in (i, j):
                part = words[k][a : a + SPLICED]
                own += part
                gold += [langs[k]] * len(part)
        out.append((own, gold))
    return out


def learn(texts: list[bytes], langs: list[str], rounds: int = 30, rate: float = 0.3, decay: float = 1e-4, group_words: int = 100_000) -> Model:
    """Adagrad on the mean log-likelihood of a word, with a quadratic penalty."""
    labels = sorted(set(langs))
    k = len(labels)
    weights, transitions = np.zeros((1 << BITS, k)), np.where(np.eye(k) > 0, 2.0, 0.0)
    own = [(w, x) for w, x in ((chain_words(t), x) for t, x in zip(texts, langs, strict=True)) if w]
    if not own:
        return Model(labels, weights, transitions)
    words, gold_of = [w for w, _ in own], [[x] * len(w) for w, x in own]
    for w, x in splices(words, [x for _, x in own]):
        words.append(w)
        gold_of.append(x)
    number = {x: i for i, x in enumerate(labels)}
    lens = np.array([len(w) for w in words], dtype=np.int64)
    gold = np.fromiter((number[x] for g in gold_of for x in g), dtype=np.int8, count=int(lens.sum()))
    types: dict[bytes, int] = {}
    at = np.fromiter((types.setdefault(x, len(types)) for w in words for x in w), dtype=np.int32)
    del words, gold_of, own
    features = [word_features(w.decode("utf-8", "replace")) for w in types]
    f_lens = np.array([len(f) for f in features], dtype=np.int64)
    flat = np.array([i for f in features for i in f], dtype=np.int32)
    n_types = len(types)
    del features, types
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    n, ends = len(at), np.cumsum(lens)
    inside = np.ones(n, dtype=bool)
    inside[ends - lens] = False  # words that follow another one
    steps = np.bincount(gold[:-1][inside[1:]].astype(np.int64) * k + gold[1:][inside[1:]], minlength=k * k).reshape(k, k)
    # texts in groups of about group_words words, one after the other in each round, so that memory has a bound
    edges = np.flatnonzero(np.diff(ends // group_words, prepend=-1))
    groups = list(zip(edges.tolist(), [*edges[1:].tolist(), len(lens)], strict=True))
    for _ in range(rounds):
        emissions = np.stack([sums(weights[flat, j], f_lens) for j in range(k)], axis=1)
        by_type, pairs = np.zeros((n_types, k)), np.zeros((k, k))
        for a, b in groups:
            mine = slice(ends[a] - lens[a], ends[b - 1])
            chain = Chain(emissions[at[mine]], lens[a:b], transitions)
            error = -chain.marginals()
            error[np.arange(len(error)), gold[mine]] += 1
            by_type += np.stack([np.bincount(at[mine], error[:, j], minlength=n_types) for j in range(k)], axis=1)
            pairs += chain.pairs()
        g_w = np.stack([np.bincount(flat, np.repeat(by_type[:, j], f_lens), minlength=1 << BITS) for j in range(k)], axis=1) / n - decay * weights
        g_t = (steps - pairs) / n - decay * transitions
        seen_w += g_w * g_w
        seen_t += g_t * g_t
        weights += rate * g_w / np.sqrt(seen_w)
        transitions += rate * g_t / np.sqrt(seen_t)
    return Model(labels, weights, transitions)


def training_rows(docs: DataFrame, sample_docs: int, sample_bytes: int, doc_id: str, text: str, lang: str) -> list:
    """(t, l) of the drawn documents: ids and hashes of texts are drawn first, and only the drawn texts are fetched."""
    rows = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    own = rows.select(F.col(doc_id).cast("string").alias("i"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("t"), F.col(lang).cast("string").alias("l"))
    few = drawn(own.select("i", "h"), sample_docs, "i", "h").distinct()
    texts = own.join(F.broadcast(few), ["i", "h"]).dropDuplicates(["i", "h"])
    order = F.xxhash64("i", "h")
    return within_bytes(texts.withColumn("o", order), "t", sample_bytes, "o", "i", "h").select("t", "l").collect()


def trained(docs: DataFrame, sample_docs: int = 1200, sample_bytes: int = 64 << 20, rounds: int = 30, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    rows = training_rows(docs, sample_docs, sample_bytes, doc_id, text, lang)
    return learn([bytes(r["t"]) for r in rows], [r["l"] for r in rows], rounds)


def language_id(docs: DataFrame, sample_docs: int = 1200, rounds: int = 30, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """All columns of docs, with held_out, lang_pred and score (columns of these names are replaced)."""
    if model is None:
        model = trained(docs, sample_docs, rounds=rounds, doc_id=doc_id, text=text, lang=lang)
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.transitions))
    base = docs.drop("held_out", "lang_pred", "score")
    name = uuid.uuid4().hex

    def make():
        m = Model(*sent.value)
        memo = kept(name, lambda: Ids(m.emissions, code="f", most=400_000))

        def of(texts):
            if not m.labels:
                return [pa.array(["und"] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
            p = m.scores(memo, texts)
            best, score = p.argmax(1), p.max(1)
            return [pa.array([m.labels[i] if s > 0 else "und" for i, s in zip(best.tolist(), score.tolist(), strict=True)], pa.string()), pa.array(score, pa.float64())]

        return of

    out = base.select("*", by_text(make, "lang_pred string, score double", 1 << 20)(F.col(text).cast("string")).alias(name))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"), held_out(doc_id).alias("held_out"))


def spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans of every row: the runs of words of one language (first place of the chain, number, language)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.transitions))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def make():
        m = Model(*sent.value)

        def runs_of(t: bytes) -> list[dict]:
            out, at = [], 0
            for lang, own in groupby(x for _, x in m.word_labels(t)):
                n = sum(1 for _ in own)
                out.append({"first": at, "words": n, "lang": lang})
                at += n
            return out

        return lambda texts: [pa.array([runs_of(t) for t in texts], kind)]

    out = docs.select(doc_id, by_text(make, "spans array<struct<first:int,words:int,lang:string>>", 1 << 20)(F.col(text).cast("string")).alias("s"))
    return out.select(doc_id, F.col("s")["spans"].alias("spans"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs).select("doc_id", "held_out", "lang_pred", "score")
