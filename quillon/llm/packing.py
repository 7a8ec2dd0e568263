"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TOKEN_BLOCK, Scratch, arrow_map, ragged, texts_of
from .wordbpe import WordEncoder

#: Pieces of one length that are ranked together.
RANKED = 250
#: Sequences that may be opened, as a share of the least number, before pieces are cut.
SPARE = 0.01
#: Ids as bytes.
ID = "<u4"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut at each `capacity`th: (doc_id, start, length, ids_crc32, doc_tokens[, ids as bytes])."""

    def each(batch):
        ids, offsets = WordEncoder.load(tokenizer).encode(texts_of(batch, "text"))
        n = np.diff(offsets) + 1
        ends = np.cumsum(n)
        whole = np.full(int(ends[-1]), end_id, ID)
        whole[ragged(ends - n, n - 1)] = ids
        count = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), count)
        start = ragged(np.zeros(len(n), np.int64), count) * capacity
        length = np.minimum(n[doc] - start, capacity)
        low = (ends - n)[doc] + start
        data = memoryview(whole.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(low.tolist(), length.tolist())]
        out = {"doc_id": batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "doc_tokens": n[doc]}
        if with_ids:
            out["ids"] = pa.array([data[4 * a : 4 * (a + k)] for a, k in zip(low.tolist(), length.tolist())], pa.binary())
        return pa.RecordBatch.from_pydict(out)

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids, block=TOKEN_BLOCK)


def plan(counts: dict[int, int], capacity: int, linear: float, quadratic: float, spare: float = SPARE) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset, kept, next rank): rank r of a length goes to first sequence + r - first rank.

    As many sequences are opened as the tokens fill. Descending lengths go, one piece after the other, to the sequence
    of lowest cost that still has room. Where none has, a new one is opened while those opened so are at most the share
    `spare` of the first; from then on pieces are cut: the first `kept` tokens fill the largest room, and the rest is a
    piece of that length, of rank next rank + r - first rank. So no corpus takes more than the least number of sequences
    and that share. Sequences of equal content are one class with a count: the work and the size of the plan depend on
    the number of lengths (at most `capacity`), not on that of the pieces.
    """
    counts = dict(counts)
    opened = -(-sum(k * n for k, n in counts.items()) // capacity)
    more = int(opened * spare)
    ready: list[tuple[float, int, int, int]] = [(0.0, 0, opened, capacity)] if opened else []  # cost, first sequence, sequences, room
    waiting: dict[int, list[tuple[float, int, int, int]]] = {}
    runs = []
    price = lambda n: linear * n + quadratic * n * n

    def put(cost: float, first: int, some: int, room: int, length: int) -> None:
        if room >= length:
            heapq.heappush(ready, (cost, first, some, room))
        elif room:
            waiting.setdefault(room, []).append((cost, first, some, room))

    for length in range(max(counts, default=0), 0, -1):
        for x in waiting.pop(length, []):
            heapq.heappush(ready, x)
        left, rank = counts.get(length, 0), 0
        while left:
            if ready:
                cost, first, some, room = heapq.heappop(ready)
                take = min(left, some)
                if take < some:
                    heapq.heappush(ready, (cost, first + take, some - take, room))
                runs.append((length, rank, take, first, capacity - room, length, 0))
                put(cost + price(length), first, take, room - length, length)
            elif more:  # a new sequence is the only one with room until it is full, so such ones are filled together
                wide = capacity // length
                full = min(more, left // wide)
                for k in range(wide if full else 0):
                    runs.append((length, rank + k * full, full, opened, k * length, length, 0))
                if full:
                    put(wide * price(length), opened, full, capacity - wide * length, length)
                    take = wide * full
                else:
                    full, take = 1, 0
                    heapq.heappush(ready, (0.0, opened, 1, capacity))
                opened, more = opened + full, more - full
            else:
                room = max(waiting)
                cost, first, some, _ = waiting[room].pop()
                if not waiting[room]:
                    del waiting[room]
                take = min(left, some)
                if take < some:
                    waiting.setdefault(room, []).append((cost, first + take, some - take, room))
                rest = length - room
                runs.append((length, rank, take, first, capacity - room, room, counts.get(rest, 0)))
                counts[rest] = counts.get(rest, 0) + take
            rank, left = rank + take, left - take
    return np.array(runs, np.int64).reshape(-1, 7)


def placed(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, start within it, length, sequence, offset) of the parts of pieces, whole or cut; runs are sorted by length and rank."""
    key, piece, start, out = (runs[:, 0] << 44) + runs[:, 1], np.arange(len(length)), np.zeros(len(length), np.int64), []
    while len(piece):
        run = runs[np.searchsorted(key, (length << 44) + rank, "right") - 1]
        out.append((piece, start, run[:, 5], run[:, 3] + rank - run[:, 1], run[:, 4]))
        on = run[:, 5] < length
        piece, start, length, rank = piece[on], (start + run[:, 5])[on], (length - run[:, 5])[on], (run[:, 6] + rank - run[:, 1])[on]
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 5


def ranked(spark: SparkSession, found: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds `rank`, 0 and up within each length by a hash bucket, doc_id, start and checksum.

    A length has a bucket for each RANKED of its pieces, dealt by the number of the piece, so neither a length nor a
    doc_id meets in one task. That number comes from where the row was read.
    """
    buckets = spark.createDataFrame([(k, 1 + n // RANKED) for k, n in counts.items()], "length long, __of long")
    found = found.join(F.broadcast(buckets), "length").withColumn("__b", F.pmod(F.xxhash64("doc_id", "start", "piece"), F.col("__of"))).drop("__of")
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = Window.partitionBy("length", "__b").orderBy("doc_id", "start", "ids_crc32", "piece")
    out = found.withColumn("__k", F.row_number().over(own)).join(sums.select("length", "__b", "__before"), ["length", "__b"])
    return out.withColumn("rank", F.col("__before") + F.col("__k") - 1).drop("__b", "__before", "__k")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 1024, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of docs(doc_id, text).

    A document's tokens are its ids and the end id; null and empty texts have the end id alone. Documents of over
    `capacity` tokens are cut at its multiples; further cuts are made where else more than the least number of sequences
    and SPARE of it were needed. A piece of n tokens is estimated to cost linear * n + quadratic * n * n. Repeated rows
    are packed each; pieces without a doc_id are packed like any other; further columns are left out. with_ids adds
    `ids`, the piece's tokens: a sequence's tokens are those of its pieces by offset.
    """
    scratch = Scratch(spark, "packing")
    found = scratch.put(pieces(docs, tokenizer, end_id, capacity).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(counts, capacity, linear, quadratic)
    shared = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def place(batches):
        for batch in batches:
            piece, begin, length, sequence, offset = placed(shared.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            some = batch.take(pa.array(piece))
            whole = pa.array(length == some.column("length").to_numpy())
            yield pa.RecordBatch.from_pydict({
                "doc_id": some.column("doc_id"), "start": pc.add(some.column("start"), pa.array(begin)), "length": length, "ids_crc32": pc.if_else(whole, some.column("ids_crc32"), pa.scalar(None, pa.int64())),
                "doc_tokens": some.column("doc_tokens"), "sequence_id": sequence, "offset": offset, "begin": begin, "whole": some.column("length"), "crc": some.column("ids_crc32"),
            })

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, begin long, whole long, crc long"
    out = ranked(spark, found, counts).mapInArrow(place, schema)
    names = out.columns[:7]
    if not (with_ids or (runs[:, 5] < runs[:, 0]).any()):
        return out.select(*names)
    # parts of cut pieces have their checksums from their ids: their documents alone are encoded again
    out = scratch.put(out, "placed")
    todo = out if with_ids else out.where("ids_crc32 is null")
    some = docs.select("doc_id", "text")
    if not with_ids:
        some = some.join(todo.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    same = ["doc_id", "start", "length", "ids_crc32"]  # pieces that agree in these are as good as one another
    ids = pieces(some, tokenizer, end_id, capacity, True).groupBy(*same).agg(F.first("ids").alias("ids")).select(*[F.col(c).alias(f"__{c}") for c in same], "ids")
    key = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("start") - F.col("begin") == F.col("__start")) & (F.col("whole") == F.col("__length")) & (F.col("crc") == F.col("__ids_crc32"))

    def own(batches):
        for batch in batches:
            data = [memoryview(x.as_buffer())[4 * a : 4 * (a + n)] for x, a, n in zip(batch.column("ids"), batch.column("begin").to_pylist(), batch.column("length").to_pylist())]
            row = {n: batch.column(n) for n in names} | {"ids_crc32": pa.array([zlib.crc32(x) for x in data], pa.int64())}
            yield pa.RecordBatch.from_pydict(row | ({"ids": pa.array([np.frombuffer(x, ID).astype(np.int32) for x in data], pa.list_(pa.int32()))} if with_ids else {}))

    schema = ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids
    told = todo.join(ids, key).select(*names, "begin", "ids").mapInArrow(own, schema)
    return told if with_ids else out.where("ids_crc32 is not null").select(*names).unionByName(told)
