"""Threshold-scaled sketches: all shingle hashes below a fixed fraction of the hash range."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST, LONG, TEXT_BLOCK, bucket_of, id_bounds, repeated_ids, texts_of, trim, words_of

#: Words of a shingle, and the share 1 / SCALE of the hash range that a sketch keeps.
WIDTH, SCALE = 5, 8
#: Distinct words whose hashes a worker keeps between batches.
KEPT_WORDS = 500_000
#: Odd multipliers of the shingle hash and its finalizer.
ROLL, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_words: dict[str, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX2)
    return h ^ (h >> np.uint64(31))


def sketches(texts: pa.Array, width: int = WIDTH, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted distinct hashes below 2**64 / scale of each text's shingles of `width` words.

    Words lie between ASCII white space; a text with fewer words has one shingle of all of them, without words none.
    A text none of whose hashes is below the threshold keeps its least one, so that any text with words has a sketch.
    """
    index, forms, offsets = words_of(texts)
    trim(_words, KEPT_WORDS)
    get, digest = _words.get, xxhash.xxh64_intdigest
    own = []
    for w in forms:
        if (h := get(w)) is None:
            h = digest(w.encode())
            if len(w) <= LONG:
                _words[w] = h
        own.append(h)
    word = np.array(own, np.uint64)[index]
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        h = np.zeros(len(word), np.uint64)
        for k in range(width):  # a text's last words wrap into the next text; those shingles are dropped below
            h = h * np.uint64(ROLL) + np.roll(word, -k)
        inside = np.arange(len(word)) < np.repeat(offsets[1:] - width + 1, n)
        short = (n > 0) & (n < width)
        if short.any():
            for d in np.flatnonzero(short):
                total = np.uint64(n[d])
                for x in word[offsets[d] : offsets[d + 1]]:
                    total = total * np.uint64(ROLL) + x
                h[offsets[d]] = total
            inside[offsets[:-1][short]] = True
        h = _mix(h)
    doc = np.repeat(np.arange(len(n)), n)
    low = inside & (h <= np.uint64((1 << 64) // scale - 1))
    least = np.full(len(n), np.iinfo(np.uint64).max, np.uint64)
    bare = (n > 0) & (np.bincount(doc[low], minlength=len(n)) == 0)
    if bare.any():
        some = inside & bare[doc]
        np.minimum.at(least, doc[some], h[some])
    at, h = doc[low], h[low]
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    at, h = at[new], h[new]
    cuts = np.searchsorted(at, np.arange(len(n) + 1))
    return [least[d : d + 1] if bare[d] else h[a:b] for d, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()))]


def to_text(sketch: np.ndarray) -> str:
    """16 hex digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both <= np.uint64((1 << 64) // scale - 1)]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float | None:
    """The estimated share of a's shingles that b has too; 1 if a has none.

    A text none of whose hashes is below the threshold cannot be looked for in another: None, unless both sketches are equal.
    """
    if len(a) and a[0] > np.uint64((1 << 64) // scale - 1):
        return 1.0 if np.array_equal(a, b) else None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard similarity; 1 for two texts without words."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


# ---------------------------------------------------------------- neighbours by doc_id


def _second(bounds: np.ndarray) -> Column:
    """The second key of a row: a hash of the text where its doc_id fills buckets of its own; so texts are read for it only if there is such a doc_id."""
    hot = repeated_ids(bounds)
    return F.when(F.coalesce(F.col("doc_id"), F.lit(LEAST)).isin(hot.tolist()), F.xxhash64("text")).otherwise(F.lit(0).cast("long")) if len(hot) else F.lit(0).cast("long")


def _bucket(bounds: np.ndarray) -> Column:
    """The bucket of a row, from its doc_id (`id`) and second key, by search in the bounds, an array of constants."""

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(ids.to_numpy(np.int64), second.to_numpy(np.int64), bounds).astype(np.int32))

    return bucket("id", "second")


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, halo, doc_id, text), sorted by bucket, halo and descending (doc_id, second key, text) within each partition.

    Documents lie in buckets of doc_id, those of a doc_id of very many rows in several by a hash of the text; a bucket
    also has, as its halo, the largest document of the bucket below it (the lowest bucket: of the highest), so that each
    document's next one follows it in its own task. Each text moves once, but for a bucket's largest. Rows go through a
    task one after the other.
    """
    bounds = id_bounds(docs.select("doc_id"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(LEAST)).alias("id"), _second(bounds).alias("second"), "text")
    largest = F.max(F.struct("id", "second")) if len(repeated_ids(bounds)) else F.struct(F.max("id").alias("id"), F.lit(0).alias("second"))
    most = keyed.select("id", "second").groupBy(_bucket(bounds).alias("b")).agg(largest.alias("m")).collect()  # a row for each bucket
    filled = sorted((r["b"], r["m"]["id"], r["m"]["second"]) for r in most)
    above = {(i, second): filled[(k + 1) % len(filled)][0] for k, (_, i, second) in enumerate(filled)}
    keys = np.array(sorted(above), np.int64).reshape(-1, 2)
    targets = np.array([above[tuple(k)] for k in keys.tolist()], np.int32)

    @F.pandas_udf("array<int>")
    def both(ids: pd.Series, second: pd.Series) -> pd.Series:
        ids, second = ids.to_numpy(np.int64), second.to_numpy(np.int64)
        own = bucket_of(ids, second, bounds).astype(np.int32)
        out = own.reshape(-1, 1).tolist()
        for i in np.flatnonzero(np.isin(ids, keys[:, 0])):
            for k in range(np.searchsorted(keys[:, 0], ids[i]), np.searchsorted(keys[:, 0], ids[i], "right")):
                if keys[k, 1] == second[i]:
                    out[i] = [own[i], targets[k]]
        return pd.Series(out)

    dealt = keyed.select("doc_id", "second", "text", F.posexplode(both("id", "second")).alias("halo", "bucket"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "halo", F.desc("doc_id"), F.desc("second"), F.desc("text")).drop("second")


def compare_edited(spark: SparkSession, docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Sketches of docs(doc_id, text) and of their edited texts.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next): the
    edited text has the last half of the code points replaced by as many first ones (or all) of the next document by
    descending doc_id; after the last comes the first. near_ is the likeness (Jaccard), in_ the containment of the
    document's shingles, null where it is too short for an estimate. Null texts are empty: they have an empty fingerprint, and likeness 1 with each other, 0 with
    others. Documents of equal doc_id follow each other by text; those without one come last. A lone document is its
    own next. Further columns are left out.
    """

    def pairs(batches):
        """(doc_id, text, next text) of a sorted partition."""
        held = bucket = None
        for batch in batches:
            texts = texts_of(batch, "text")
            for b, halo, doc_id, text in zip(batch.column("bucket").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), texts.to_pylist()):
                if bucket != b:
                    held, bucket = None, b
                if held:
                    yield *held, text
                held = None if halo else (doc_id, text)

    def some(batches):
        out, size = [], 0
        for row in pairs(batches):
            out.append(row)
            size += len(row[1])
            if size > TEXT_BLOCK // 2:
                yield out
                out, size = [], 0
        if out:
            yield out

    def run(batches):
        for rows in some(batches):
            doc_ids, texts, nexts = zip(*rows)
            edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
            own, new = (sketches(pa.array(x, pa.large_string()), width, scale) for x in (texts, edited))
            # the next document's sketch: that of the following row, or computed where the run of rows breaks
            follows = [k + 1 < len(rows) and nexts[k] == texts[k + 1] for k in range(len(rows))]
            lone = [k for k, f in enumerate(follows) if not f]
            extra = dict(zip(lone, sketches(pa.array([nexts[k] for k in lone], pa.large_string()), width, scale)))
            after = [own[k + 1] if f else extra[k] for k, f in enumerate(follows)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, pa.int64()), "n_chars": pa.array(list(map(len, texts)), pa.int64()), "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                "fingerprint": list(map(to_text, own)), "edited_fingerprint": list(map(to_text, new)),
                "near_edited": list(map(likeness, own, new)), "near_next": list(map(likeness, own, after)), "in_edited": pa.array([containment(a, b, scale) for a, b in zip(own, new)], pa.float64()), "in_next": pa.array([containment(a, b, scale) for a, b in zip(own, after)], pa.float64()),
            })

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"
    return with_next(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)
