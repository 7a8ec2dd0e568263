"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels."""

from __future__ import annotations

import array
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG, arrow_map, give_back, ragged, texts_of, trim, words_of

#: The classifier is fitted on at most this many labelled documents, those of the least hash of doc_id, less those of
#: more bytes than FIT_BYTES: so what comes to the driver is bounded. All documents are scored whole.
FIT_DOCUMENTS, FIT_BYTES = 6000, 1 << 15
#: Log-odds below which a sentence is quiet, and the most that all quiet ones of a text take from log(1 - P): below log 2,
#: so that they alone never make a text toxic.
QUIET, LIMIT = -3.0, 0.5
#: Log-odds of a sentence where nothing could be learnt: any number of them scores zero.
NOTHING = -60.0
#: Hashed features (a power of two), lengths of word beginnings, and rounds of gradient descent.
FEATURES, BEGINNINGS, ROUNDS = 1 << 18, range(3, 10), 120
#: A feature counts if so many of the fitted documents have it, and toxic ones this many times as often as all do.
SEEN_IN, LIFT = 5, 1.5
#: Distinct words whose scores a worker keeps between batches.
KEPT_WORDS = 500_000
#: Sentences end with a word that ends so, or with a line.
ENDS, LINE = (".", "!", "?"), "\x1e"
LETTERS = regex.compile(r"\p{L}+")


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def held_out(doc_id):
    """Rows whose labels nothing may learn from; a row without a doc_id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def features(word: str) -> list[int]:
    """Of each run of letters in lower case: itself and its beginnings, hashed."""
    out = []
    for run in LETTERS.findall(word.lower()):
        out.append(zlib.crc32(("=" + run).encode()) % FEATURES)
        out.extend(zlib.crc32(run[:k].encode()) % FEATURES for k in BEGINNINGS if k <= len(run))
    return out


def sentences_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Words: index and forms as words_of has them; each word's sentence; the n + 1 offsets of texts in sentences."""
    index, forms, offsets = words_of(pc.replace_substring(texts, "\n", f" {LINE} "))
    n = len(offsets) - 1
    line = np.fromiter((f == LINE for f in forms), bool, len(forms))[index] if len(index) else np.zeros(0, bool)
    last = np.fromiter((f.endswith(ENDS) for f in forms), bool, len(forms))[index] | line if len(index) else line
    begins = np.ones(len(index), bool)
    begins[1:] = last[:-1] & ~line[1:]  # the end of a line goes with the sentence before it
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    sentence = np.cumsum(begins) - 1
    return index, forms, sentence, np.concatenate(([0], np.cumsum(begins)))[offsets].reshape(n + 1)


def once(index: np.ndarray, sentence: np.ndarray, forms: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word once a sentence."""
    pair = np.unique(sentence.astype(np.int64) * forms + index)
    return pair % forms, pair // forms


def expit(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def noisy_or(z: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(1 - P) of each text, where P is the probability that any of its sentences with log-odds z is toxic, and each sentence's part in it.

    Quiet sentences together count for less than LIMIT, a few of them as they are: sums of theirs x as x / (1 + x / LIMIT).
    So no length of harmless text adds up to a toxic one.
    """
    loss, quiet = np.logaddexp(0, z), z < QUIET
    total = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[offsets])
    low = total(np.where(quiet, loss, 0.0))
    part = np.where(quiet, np.repeat(1 / (1 + low / LIMIT) ** 2, np.diff(offsets)), 1.0)
    return -total(np.where(quiet, 0.0, loss)) - low / (1 + low / LIMIT), part


def _document_counts(index: np.ndarray, doc: np.ndarray, flat: np.ndarray, wide: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents each feature occurs, and in how many toxic ones."""
    first, seen, toxic = np.cumsum(wide) - wide, np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for begin in range(0, len(y), 256):  # a few documents at a time: their pairs of document and feature are many
        lo, hi = np.searchsorted(doc, (begin, begin + 256))
        pair = np.unique((doc[lo:hi].astype(np.int64) - begin) * len(wide) + index[lo:hi])
        own, word = pair // len(wide), pair % len(wide)
        pair = np.unique(np.repeat(own, wide[word]) * FEATURES + flat[ragged(first[word], wide[word])])
        seen += np.bincount(pair % FEATURES, minlength=FEATURES)
        toxic += np.bincount(pair[y[begin + pair // FEATURES] > 0] % FEATURES, minlength=FEATURES)
    return seen, toxic


def fit(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, rate: float = 0.1, lasso: float = 2e-5) -> Model:
    """Weights that maximise the likelihood of the labels; Adam on all texts together, so the result is always the same.

    Weights are zero or more: words are evidence of toxicity or none, and no number of harmless words outweighs it. A
    word counts once a sentence, however often it is repeated there.
    """
    weights, bias = np.zeros(FEATURES), -5.0
    if not len(texts) or labels.all() or not labels.any():
        return Model(weights.astype(np.float32), NOTHING)
    place, parts = {}, []
    for begin in range(0, len(texts), 256):  # a few texts at a time, so that no array is as long as all of them
        index, forms, sentence, offsets = sentences_of(pa.array(texts[begin : begin + 256], pa.large_string()))
        own = np.array([place.setdefault(f, len(place)) for f in forms], np.int32)
        parts.append((own[index], sentence.astype(np.int32), np.diff(offsets)))
    sizes = np.cumsum([0, *[int(n.sum()) for _, _, n in parts]])
    index, sentence, offsets = np.concatenate([x for x, _, _ in parts]), np.concatenate([x + k for (_, x, _), k in zip(parts, sizes.tolist())]), np.cumsum(np.concatenate([[0], *[n for _, _, n in parts]]))
    forms = list(place)
    del place, parts
    flat, wide = array.array("i"), array.array("i")
    for f in forms:
        some = features(f)
        flat.extend(some)
        wide.append(len(some))
    n_forms, flat, wide = len(forms), np.array(flat, np.int32), np.array(wide, np.int32)
    del forms
    owner = np.repeat(np.arange(n_forms, dtype=np.int32), wide)
    y, doc = labels.astype(float), np.repeat(np.arange(len(texts)), np.diff(offsets))
    n = int(offsets[-1])
    seen = _document_counts(index, doc[sentence], flat, wide, y)
    useful = ((seen[0] >= SEEN_IN) & (seen[1] >= LIFT * y.mean() * seen[0]))[flat]
    flat, owner = flat[useful], owner[useful]
    told = (np.bincount(owner, minlength=n_forms) > 0)[index]  # words without such a feature have no part in what follows
    index, sentence = once(index[told], sentence[told], n_forms)
    del told, useful
    slow, fast, slow_b, fast_b = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    for k in range(1, rounds + 1):
        word = np.bincount(owner, weights[flat], n_forms)
        z = bias + np.bincount(sentence, word[index], n)
        clean, part = noisy_or(z, offsets)
        p = -np.expm1(clean)
        pull = np.where(y > 0, -np.exp(clean) / np.maximum(p, 1e-9), 1.0)
        g = pull[doc] * expit(z) * part
        g_word = np.bincount(index, g[sentence], n_forms)
        g_w, g_b = np.bincount(flat, g_word[owner], FEATURES) / len(texts) + lasso, g.sum() / len(texts)
        slow, fast = 0.9 * slow + 0.1 * g_w, 0.99 * fast + 0.01 * g_w * g_w
        slow_b, fast_b = 0.9 * slow_b + 0.1 * g_b, 0.99 * fast_b + 0.01 * g_b * g_b
        step = rate * np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        weights = np.maximum(0, weights - step * slow / (np.sqrt(fast) + 1e-5))
        bias -= step * slow_b / (np.sqrt(fast_b) + 1e-5)
    return Model(weights.astype(np.float32), float(bias))


def fit_labels(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> Model:
    """Fits on at most `most` documents of docs(doc_id, text) that labels(doc_id, toxic) marks and that are not held out.

    The texts of these come to the driver, which gives their memory back. Null labels do not count; of several labels of a document the highest does,
    of several texts any one. Without labels, or with labels of one kind, every document scores near zero.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(some), "doc_id")
    rows = sorted({r["doc_id"]: r for r in rows.collect()}.values(), key=lambda r: r["doc_id"])
    model = fit([r["text"] for r in rows], np.array([r["toxic"] > 0 for r in rows], bool))
    del rows
    give_back()  # the driver lives on, too
    return model


_scores: dict[str, float] = {}
_weights: list[float] = []


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.5, located: bool = False) -> DataFrame:
    """docs with `score` (0 to 1), `predicted` (1 at the threshold or above, int), n_sentences and n_offending added.

    A score is that of the whole text alone: one less the product of its sentences' probabilities of being clean, where
    those of hardly any weight count less the more there are. Null and empty texts have no sentence and score 0. located adds `offending`, the sentences at the threshold or above.
    Other columns and repeated rows stay; columns of docs with these names are replaced.
    """
    added = {"score": "double", "predicted": "int", "n_sentences": "long", "n_offending": "long"} | ({"offending": "array<string>"} if located else {})
    docs = docs.drop(*added)
    shared = spark.sparkContext.broadcast(model)

    def start():
        _scores.clear()
        _weights[:] = shared.value.weights.tolist()

    def end():
        _scores.clear()
        _weights.clear()

    def each(batch):
        index, forms, sentence, offsets = sentences_of(texts_of(batch, "text"))
        trim(_scores, KEPT_WORDS)
        get = _scores.get
        word = np.zeros(len(forms))
        for k, f in enumerate(forms):
            if (s := get(f)) is None:
                s = sum([_weights[x] for x in features(f)])
                if len(f) <= LONG:
                    _scores[f] = s
            word[k] = s
        n = int(offsets[-1])
        told = (word > 0)[index]  # few words: the others say nothing
        one, of = once(index[told], sentence[told], max(1, len(forms)))
        z = shared.value.bias + (np.bincount(of, word[one], n) if n else np.zeros(0))
        score = np.clip(-np.expm1(noisy_or(z, offsets)[0]), 0, 1)
        bad = expit(z) >= threshold
        upto = np.concatenate(([0], np.cumsum(bad)))
        out = [score, (score >= threshold).astype(np.int32), np.diff(offsets), upto[offsets[1:]] - upto[offsets[:-1]]]
        if located:
            lows = np.searchsorted(sentence, np.arange(n + 1))
            said = {s: " ".join(forms[i] for i in index[lows[s] : lows[s + 1]] if forms[i] != LINE) for s in np.flatnonzero(bad).tolist()}
            out.append(pa.array([[said[s] for s in range(a, b) if s in said] for a, b in zip(offsets, offsets[1:])], pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, *added])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{k} {v}" for k, v in added.items()])
    return arrow_map(docs, each, schema, start=start, end=end)
