"""Token ids as canonical length-limited Huffman codes in independent blocks.

The file format, a folder of two Parquet tables, one row a block so that lost tasks are written again:

  codebook (id, bits): the code length of each id that occurs; codes are canonical: by length, then id.
  blocks (part, block, before, n_ids, data): documents in ascending doc_id, part after part (buckets of doc_ids), block after block;
    `before` is the number of ids in the part's earlier blocks. `data` is
      "QHUF", version 1, checkpoint distance K, number of documents D (uint32 each, little-endian);
      D doc_ids (int64); D flags (uint8, 1: no doc_id); D counts of ids (uint32); D byte lengths of streams (uint32);
      for each document the bit offset of its ids K, 2K, ... in its stream (uint32); the streams, each from a new byte,
      most significant bit first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST, TOKEN_BLOCK, Scratch, arrow_map, bucket_of, id_bounds, ragged, repeated_ids, texts_of
from .wordbpe import WordEncoder

MAGIC, VERSION = b"QHUF", 1
#: Ids between two checkpoints; stream bytes and documents after which a block ends.
STEP, BLOCK_BYTES, BLOCK_DOCS = 256, 1 << 18, 8192


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for ids with a count, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    row, items = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weights, pairs))
        at = np.argsort(both, kind="stable")
        row = both[at]
        items.append(at < len(weights))
    need = 2 * len(weights) - 2
    for is_item in reversed(items):
        own = int(is_item[:need].sum())
        lengths[order[:own]] += 1
        need = 2 * (need - own)
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in range(1, int(lengths.max(initial=0)) + 1):
        some = order[lengths[order] == n]
        code <<= n - last
        codes[some], code, last = code + np.arange(len(some)), code + len(some), n
    return codes


def decoding_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each `limit` bits: the id they begin with, and its code's length."""
    ids, bits = np.zeros(1 << limit, np.int32), np.zeros(1 << limit, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    wide = 1 << (limit - lengths[order])
    total = int(wide.sum())
    ids[:total], bits[:total] = np.repeat(order, wide), np.repeat(lengths[order], wide)
    return ids, bits


def encode(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Streams of documents with n ids each: bytes of all, bytes of each, all checkpoints, checkpoints of each."""
    wide = lengths[ids]
    upto = np.concatenate(([0], np.cumsum(wide)))
    first = np.cumsum(n) - n
    size = -(-(upto[first + n] - upto[first]) // 8)
    base = (np.cumsum(size) - size) * 8
    at = upto[:-1] + np.repeat(base - upto[first], n)
    total = int(size.sum())
    words = np.zeros(total // 4 + 3, np.uint64)
    if len(ids):
        # a code lies in two words of 32 bits; the codes that begin in one word are next to each other
        value = codes[ids].astype(np.uint64) << (64 - wide - (at & 31)).astype(np.uint64)
        word = at >> 5
        new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words[word[new]] = np.add.reduceat(value >> np.uint64(32), new)
        words[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    data = words.astype(">u4").view(np.uint8)[:total]
    marks = np.maximum(0, -(-n // STEP) - 1)
    where = np.repeat(first, marks) + (ragged(np.zeros(len(n), np.int64), marks) + 1) * STEP
    return data, size, at[where] - np.repeat(base, marks), marks


def decode(data: np.ndarray, at: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """The ids of runs of n ids that begin at bits `at` of data; all runs go on together, one id of each at a time."""
    ids, bits = table
    d = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    window = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
    order = np.argsort(-n, kind="stable")
    at, left, to = at[order].copy(), n[order], (np.cumsum(n) - n)[order]
    out = np.empty(int(n.sum()), np.int32)
    live = len(left)
    for k in range(int(left[0]) if len(left) else 0):
        while left[live - 1] <= k:
            live -= 1
        p = at[:live]
        x = (window[p >> 3] >> (32 - limit - (p & 7)).astype(np.uint32)) & ((1 << limit) - 1)
        out[to[:live] + k] = ids[x]
        p += bits[x]
    return out


# ---------------------------------------------------------------- blocks


def to_block(doc_ids: np.ndarray, flags: np.ndarray, n: np.ndarray, sizes: np.ndarray, marks: bytes, streams: bytes) -> bytes:
    head = np.array([VERSION, STEP, len(n)], "<u4").tobytes()
    return b"".join((MAGIC, head, doc_ids.astype("<i8").tobytes(), flags.astype(np.uint8).tobytes(), n.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), marks, streams))


def from_block(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, flags, counts, first bits of runs, counts of runs, stream bytes."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a block of token ids")
    version, step, docs = np.frombuffer(data, "<u4", 3, 4).tolist()
    if version != VERSION:
        raise ValueError(f"blocks of version {version}")
    p, out = 16, []
    for kind in ("<i8", "u1", "<u4", "<u4"):
        out.append(np.frombuffer(data, kind, docs, p))
        p += out[-1].nbytes
    doc_ids, flags, n, sizes = out[0], out[1], out[2].astype(np.int64), out[3].astype(np.int64)
    runs = -(-n // step)
    marks = np.frombuffer(data, "<u4", int(np.maximum(runs - 1, 0).sum()), p)
    p += marks.nbytes
    at = np.zeros(int(runs.sum()), np.int64)
    first = np.cumsum(runs) - runs
    later = np.ones(len(at), bool)
    later[first[runs > 0]] = False
    at[later] = marks
    at += np.repeat((np.cumsum(sizes) - sizes) * 8, runs)
    inside = ragged(np.zeros(docs, np.int64), runs) * step
    return doc_ids, flags, n, at, np.minimum(np.repeat(n, runs) - inside, step), np.frombuffer(data, np.uint8, offset=p)


# ---------------------------------------------------------------- tables


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, ids, counts): each document's ids and the end id, as little-endian unsigned numbers of 16 or 32 bits.

    counts is set in the first row of some thousands: (id, how often they have it) pairs, so that counting the corpus
    reads this column alone.
    """

    def each(batch):
        encoder = WordEncoder.load(tokenizer)
        kind = "<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4"
        ids, offsets = encoder.encode(texts_of(batch, "text"))
        n = np.diff(offsets) + 1
        ends = np.cumsum(n)
        whole = np.full(int(ends[-1]), end_id, kind)
        whole[ragged(ends - n, n - 1)] = ids
        at = np.concatenate(([0], ends)).astype(np.int64) * whole.itemsize
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(whole)])
        counts = np.bincount(whole)
        used = np.flatnonzero(counts)
        pairs = np.column_stack((used, counts[used])).astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), packed.cast(pa.binary()), pa.array([pairs] + [None] * (len(n) - 1), pa.binary())], names=["doc_id", "n", "ids", "counts"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, n long, ids binary, counts binary", block=TOKEN_BLOCK)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n").to_numpy().astype(np.int64)
    ids = batch.column("ids").cast(pa.large_binary())
    offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    kind = "<u2" if offsets[-1] - offsets[0] == 2 * int(n.sum()) else "<u4"
    return np.frombuffer(ids.buffers()[2], kind, int(n.sum()), int(offsets[0])).astype(np.int64), n


def global_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; a task sends a row for each id, so the driver gets no more rows than there are ids."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for pairs in batch.column("counts").to_pylist():
                pairs = np.frombuffer(pairs, "<u4").reshape(-1, 2)
                counts[pairs[:, 0]] += pairs[:, 1]
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, scratch: Scratch | None = None) -> None:
    """Writes the ids of docs(doc_id, text) to a folder in this format."""
    scratch = scratch or Scratch(spark, "tokens")
    tokens = scratch.put(token_ids(docs, tokenizer, end_id), "tokens")
    size = max(WordEncoder.load(tokenizer).size, end_id + 1)
    limit = max(16, (size - 1).bit_length())
    lengths = code_lengths(global_counts(tokens, size), limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((lengths, codes_of(lengths)))

    bounds = id_bounds(tokens.select("doc_id"))
    repeated = repeated_ids(bounds)

    def streams(batch):
        ids, n = _ids(batch)
        data, sizes, marks, count = encode(ids, n, *shared.value)
        data, marks = data.tobytes(), marks.astype("<u4").tobytes()
        doc_id = pc.fill_null(batch.column("doc_id"), LEAST).to_numpy(zero_copy_only=False)
        second = np.zeros(len(n), np.int64)
        for k in np.flatnonzero(np.isin(doc_id, repeated)):
            second[k] = xxhash.xxh64_intdigest(batch.column("ids")[k].as_buffer()) - (1 << 63)
        ends, mark_ends = np.cumsum(sizes).tolist(), (np.cumsum(count) * 4).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket_of(doc_id, second, bounds)), batch.column("doc_id"), batch.column("n"), pa.array([marks[a:b] for a, b in zip([0, *mark_ends], mark_ends)], pa.binary()), pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary())], names=["part", "doc_id", "n", "marks", "stream"]
        )

    def blocks(batches):
        """Blocks of documents sorted by part and doc_id."""
        part = block = before = size = 0
        held = []

        def close():
            doc_ids, n, marks, data = zip(*held)
            flags = np.array([d is None for d in doc_ids])
            whole = to_block(np.array([d or 0 for d in doc_ids], np.int64), flags, np.array(n), np.array(list(map(len, data))), b"".join(marks), b"".join(data))
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "before": [before], "n_ids": [sum(n)], "data": [whole]})

        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "marks", "stream"))):
                if held and (own != part or size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS):
                    yield close()
                    block, before, held, size = block + 1, before + sum(r[1] for r in held), [], 0
                if own != part:
                    part, block, before = own, 0, 0
                held.append(row)
                size += len(row[3])
        if held:
            yield close()

    coded = arrow_map(tokens.drop("counts"), streams, "part long, doc_id long, n long, marks binary, stream binary", text="ids")
    coded = coded.repartition("part").sortWithinPartitions("part", "doc_id", "n", "stream")
    coded.mapInArrow(blocks, "part long, block long, before long, n_ids long, data binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    scratch.drop("tokens")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the folder; start counts the ids before it in all parts."""
    blocks = spark.read.parquet(f"{path}/blocks")
    bits = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}  # no more rows than the vocabulary has ids
    lengths = np.zeros(max(bits, default=0) + 1, np.int64)
    lengths[list(bits)] = list(bits.values())
    limit = max(16, int(lengths.max(initial=0)))
    base, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each bucket of doc_ids
        base[r["part"]], total = total, total + r["n"]
    shared = spark.sparkContext.broadcast((lengths, base))

    def each(batch):
        lengths, base = shared.value
        found = [from_block(memoryview(x.as_buffer())) for x in batch.column("data")]
        doc_ids, flags, n, at, run, data = zip(*found)
        shift = np.cumsum([0, *map(len, data[:-1])]) * 8
        ids = decode(np.concatenate(data), np.concatenate([a + s for a, s in zip(at, shift)]), np.concatenate(run), table_of(lengths, limit), limit)
        first = [base[p] + b for p, b in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist())]
        start = np.concatenate([f + np.cumsum(k) - k for f, k in zip(first, n)])
        n = np.concatenate(n)
        raw = memoryview(ids.astype("<u4").tobytes())
        ends = np.cumsum(n)
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
        out = {"doc_id": pa.array(np.concatenate(doc_ids), mask=np.concatenate(flags).astype(bool)), "start": start, "n_tokens": n, "ids_crc32": np.array(crc, np.int64)}
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_pydict(out)

    return arrow_map(blocks, each, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids, text="data")


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def table_of(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The decoding table, kept between batches."""
    key = lengths.tobytes()
    if key not in _tables:
        _tables.clear()
        _tables[key] = decoding_table(lengths, limit)
    return _tables[key]


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of docs(doc_id, text) under the shared folder and reads them back.

    (doc_id, start, n_tokens, ids_crc32) for each row. Null and empty texts have the end id alone; rows without a
    doc_id come first; repeated rows stay, by their ids where doc_ids are equal; further columns are left out.
    """
    scratch = Scratch(spark, "ids")
    write_ids(spark, docs, tokenizer, f"{scratch.root}/file", end_id, scratch)
    return read_ids(spark, f"{scratch.root}/file")
