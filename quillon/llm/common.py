"""What the operators of this subpackage share: tables in the shared folder, Arrow batches, word dictionaries, components."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time, and that it tokenizes at a time: tokenizing takes some 50 bytes
#: for each of them.
TEXT_BLOCK, TOKEN_BLOCK = 6 << 20, 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Written tables under the shared folder that cut the lineage; they go when the driver ends or drop() is called."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly)

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quietly(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may be gone by now
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow batches

#: glibc's; other C libraries have none.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a row is never split."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    which = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column as large strings, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


#: Classes of bytes for words_of: ASCII white space and the rest.
SPACE = np.ones(256, np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 0


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the n + 1 offsets of the texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The runs of bytes of one kind but 0, as dictionary index, dictionary, and each text's first run (n + 1 offsets).

    start: where runs begin; else at each change of kind. A run never goes on into the next text.
    """
    if start is None:
        start = changes(kind, offsets)
    at = np.flatnonzero(start)
    length, is_word = np.diff(at, append=len(data)), kind[at] != 0
    ends = np.concatenate(([0], np.cumsum(length[is_word]))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[kind != 0])))
    found = words.dictionary_encode()
    before = np.concatenate(([0], np.cumsum(is_word)))
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary, before[np.searchsorted(at, offsets)]


def changes(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the kind changes or a text begins."""
    start = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[offsets[:-1][offsets[:-1] < len(kind)]] = True
    return start


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space: index of each word's form, the forms, and each text's first word (n + 1 offsets)."""
    data, offsets = bytes_of(texts)
    index, forms, first = runs_of(data, offsets, SPACE[data])
    return index, forms.to_pylist(), first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def give_back() -> None:
    """Returns what Arrow's pool and malloc hold of freed memory to the system: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back before a task, when the last one's function is gone, and after it."""

    def task(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def arrow_map(
    df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", start: Callable[[], None] | None = None, end: Callable[[], None] | None = None, block: int = TEXT_BLOCK
) -> DataFrame:
    """mapInArrow of a function from a slice of a batch to a batch; start and end run before and after each task.

    Slices have about `block` bytes of text. After each, what it held goes back to the system.
    """

    def run(batches):
        if start:
            start()
        try:
            for batch in batches:
                for piece in pieces_of(batch, text, block):
                    if (out := each(piece)) is not None and out.num_rows:
                        yield out
                    out = piece = None
                    give_back()
        finally:
            if end:
                end()

    return df.mapInArrow(tidy(run), schema)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Of batches sorted by keys: tables of whole groups, as many groups together as make about `rows` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(whole.num_rows, bool)
        for k in keys:
            v = whole.column(k).to_numpy()
            last &= v == v[-1]
        cut = int(np.argmax(last))  # sorted, so the last group is the end of the table
        if cut:
            yield whole.slice(0, cut)
        held, n = whole.slice(cut).combine_chunks().to_batches(), whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Longer words than so many characters are not kept between batches: a worker's dictionaries are bounded in bytes too.
LONG = 64


def trim(known: dict, most: int) -> None:
    """Of a dictionary of over `most` entries, leaves the half that came first: common words come early."""
    if len(known) > most:
        first = list(itertools.islice(known.items(), most // 2))
        known.clear()
        known.update(first)


class Known:
    """Ids of words that were met before, in one array; of over `most` words the half that came first is kept.

    Words of over LONG characters are forgotten after their batch.
    """

    def __init__(self, most: int):
        self.most = most
        self.place: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.place)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.place.update(zip(words, range(n, n + len(words))))
        self.used += len(ids)

    def ids(self, index: np.ndarray, forms: list[str], learn: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words forms[index], one after the other, and the number of each; learn has those of a new word."""
        if len(self.place) > self.most:
            trim(self.place, self.most)
            self.used = int(self.start[len(self.place)])
        known = self.place.get
        at = np.fromiter([known(w, -1) for w in forms], np.int64, len(forms))
        new = np.flatnonzero(at < 0)
        long = np.fromiter((len(forms[i]) > LONG for i in new.tolist()), bool, len(new))
        new = np.concatenate((new[~long], new[long]))
        at[new] = np.arange(len(self.place), len(self.place) + len(new))
        for k in range(0, len(new), 50_000):
            some = [forms[i] for i in new[k : k + 50_000].tolist()]
            ids = [learn(w) for w in some]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._put(some, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths)
        at = at[index]
        lengths = self.length[at]
        out = self.pool[ragged(self.start[at], lengths)]
        if long.any():
            for i in new[len(new) - int(long.sum()) :].tolist():
                del self.place[forms[i]]
            self.used = int(self.start[len(self.place)])
        return out, lengths


# ---------------------------------------------------------------- order by doc_id

#: Stands for a missing doc_id: it comes first.
LEAST = -(1 << 63)
#: Rows of a bucket of neighbouring doc_ids, and the most buckets: their bounds are known to the driver and to every task.
#: Above 260 million rows buckets grow; their rows go through a task one after the other, sorted on disk, so a larger
#: one takes longer but no more memory, and buckets of 100,000 rows still outnumber any cluster's tasks.
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 17


def id_bounds(docs: DataFrame) -> np.ndarray:
    """Ascending lower bounds that cut doc_ids into about even buckets, at most MOST_BUCKETS; reads doc_id alone.

    A doc_id that has several buckets' rows is listed as often as that; its rows are dealt by a second key.
    """
    buckets = int(min(MOST_BUCKETS, max(1, docs.count() // BUCKET_ROWS)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"))
    cuts = ids.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], max(10_000, 4 * buckets))).first()[0] if buckets > 1 else None
    return np.array(cuts or [], np.int64)


def repeated_ids(bounds: np.ndarray) -> np.ndarray:
    """The doc_ids that fill buckets of their own."""
    found, many = np.unique(bounds, return_counts=True)
    return found[many > 1]


def bucket_of(ids: np.ndarray, second: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bucket of each (doc_id, second key), 0 and up in ascending order; second is a signed hash, used where a doc_id has several buckets."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    many = high - low
    part = np.floor((second.astype(np.float64) + 2.0**63) / 2.0**64 * many).astype(np.int64)
    return low + np.where(many > 0, 1 + np.minimum(part, many - 1), 0)


# ---------------------------------------------------------------- blocks of pairs

#: A table of hot keys of up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def paired_units(members: DataFrame, keys: list[str], member: str, block: int, scratch: Scratch, name: str = "hot") -> DataFrame:
    """Deals the members of each key to units (keys, tree_no, probe_no) in which every pair of members of the key meets once.

    A key with up to `block` members is one unit (0, 0). A larger one is cut by a hash of the member into chunks of
    about `block`; chunk i as tree and chunk j as probe meet in unit (i, j), i <= j. No unit grows with its key.
    Adds columns tree_no, probe_no (int), is_tree, is_probe (boolean).
    """
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    hot = scratch.put(counts.select(*keys, F.ceil(F.col("__n") / block).cast("int").alias("__chunks")), name)
    small = hot.count() <= BROADCAST_ROWS
    dealt = members.join(F.broadcast(hot) if small else hot, keys, "left").withColumn("__chunks", F.coalesce("__chunks", F.lit(1)))
    dealt = dealt.withColumn("__c", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("__chunks").cast("long")).cast("int"))
    unit = F.when(F.col("__chunks") == 1, F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("p")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("__chunks") - 1), lambda j: F.struct(F.least(F.col("__c"), j).alias("t"), F.greatest(F.col("__c"), j).alias("p")))
    )
    out = dealt.withColumn("__u", F.explode(unit))
    return out.withColumns({"tree_no": F.col("__u.t"), "probe_no": F.col("__u.p"), "is_tree": F.col("__u.t") == F.col("__c"), "is_probe": F.col("__u.p") == F.col("__c")}).drop("__u", "__c", "__chunks")


def lowest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins a[i] with b[i]; parent points to the lowest index of each set, before and after."""
    while len(a):
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        a, b, pa_, pb = a[apart], b[apart], pa_[apart], pb[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


# ---------------------------------------------------------------- hot keys

#: A key of over this many rows, or over this share of all, is hot: at most HOT_KEYS keys are, whatever the table's size.
HOT_ROWS, HOT_KEYS = 1 << 16, 1 << 16


def hot_bound(rows: int) -> int:
    """Rows that a key of a table of so many rows may have before it is split; at most HOT_KEYS keys have more."""
    return max(HOT_ROWS, -(-rows // HOT_KEYS))


def salted(rows: DataFrame, per_key: DataFrame, keys: list[str], by: list[str], bound: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `__salt`, to be joined by keys and it: the rows of a key of over `bound` rows are dealt by a hash of `by`.

    per_key has one row a key, and their number in `__n`, which is taken off. It is asked twice, so it should be a
    written table. The hot keys are broadcast: at most HOT_KEYS rows.
    """
    chunks = F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(bound))).cast("int")
    hot = per_key.where(F.col("__n") > bound).select(*keys, chunks.alias("__chunks"))
    deal = F.when(F.col("__chunks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(3), *by), F.col("__chunks")).cast("int"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", deal).drop("__chunks")
    return left, per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("__n")


def with_least(df: DataFrame, key: str, value: str, name: str, by: str, rows: int, scratch: Scratch, table: str) -> DataFrame:
    """df with `name`, the smallest `value` of its key; a hot key's rows never meet in one task, and its minima are pre-aggregated. Rows without a key go.

    A table of no more than HOT_ROWS rows has no hot key: its rows are shuffled once and get their minima where they lie.
    """
    if rows <= HOT_ROWS:
        return df.where(F.col(key).isNotNull()).withColumn(name, F.min(value).over(Window.partitionBy(key)))
    low = df.groupBy(key).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("__n"))
    left, right = salted(df, scratch.put(low, table), [key], [by], hot_bound(rows))
    return left.join(right, [key, "__salt"]).drop("__salt")


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root): for each node of an edge, the smallest node of its component.

    Large-star and small-star rounds: each round sends every neighbour of a node to the smallest one, until the edges
    are stars. Where a node can be a hub, minima are pre-aggregated and joined back, and its neighbours are dealt to
    several tasks; else a round is three shuffles, as the driver keeps account of each task. Each round is a written
    table; the driver sees a count and a checksum of it only.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = scratch.put(e, f"{name}-0"), None
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    k, now = 0, mark(e)
    while now[0] and now != seen:
        many = 2 * now[0]
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "m", "v", many, scratch, f"{name}-low-{k}").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        if many > HOT_ROWS:
            large = scratch.put(large.distinct(), f"{name}-large-{k}")
        low = with_least(large, "u", "v", "m", "v", many, scratch, f"{name}-least-{k}")
        k, seen = k + 1, now
        both = low.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))  # low is worked out once
        e = scratch.put(both.where("u <> v").distinct(), f"{name}-{k}")
        now = mark(e)
        for old in (f"{name}-{k - 1}", f"{name}-low-{k - 1}", f"{name}-large-{k - 1}", f"{name}-least-{k - 1}"):
            scratch.drop(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
