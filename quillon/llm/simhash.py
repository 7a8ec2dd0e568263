"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through shard-wise BK-trees."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, connected_components, groups_of, lowest, paired_units, texts_of, with_least

BITS = 64
#: Fingerprints of one shard that form one tree; larger shards become several trees.
TREE = 2048
#: Pairs of a probe and a node that are looked at together.
FRONTIER = 1 << 20


def fingerprint(text: bytes, width: int = 4) -> int:
    """A bit is set if it is set in over half of the XXH64 (seed 42) values of the shingles; 0 without words.

    A-Z are lower-cased, words lie between the bytes 0x20 and 0x09-0x0D, shingles are `width` words with single spaces
    (all words, where there are fewer), and repeated shingles count as often as they occur.
    """
    words = text.lower().split()  # of bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined, lengths = b" ".join(words), list(map(len, words))
    starts = [0, *itertools.accumulate(n + 1 for n in lengths[:-1])]
    last = max(0, len(words) - width)
    ends = [s + n for s, n in zip(starts[min(width, len(words)) - 1 :], lengths[min(width, len(words)) - 1 :])]
    digest, votes, seen = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), last + 1
    for k in range(0, seen, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : min(seen, k + (1 << 16))], ends[k : k + (1 << 16)])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > seen, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def each(batch):
        fps = np.array([fingerprint(t.as_buffer().to_pybytes(), width) for t in texts_of(batch, "text")], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, fp long")


def plan_blocks(n: int, radius: int, target: int = 256) -> tuple[int, int]:
    """(blocks, blocks that agree) for n fingerprints: two within the radius agree on all but `radius` of the blocks.

    More blocks make longer keys and more tables; the fewest are taken whose shards hold about `target` of n evenly
    spread fingerprints. The choice changes the cost only, never the links.
    """
    for blocks in range(radius + 1, radius + 5):
        agree = blocks - radius
        if n >> (BITS * agree // blocks) <= target:
            break
    return blocks, agree


def shards(reps: DataFrame, blocks: int, agree: int) -> DataFrame:
    """(shard, fp): each fingerprint in one shard for each choice of `agree` blocks; the shard holds the choice and its bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(blocks), agree)):
        key = F.lit(k).cast("long")
        for c in chosen:
            wide = edges[c + 1] - edges[c]
            key = F.shiftleft(key, wide).bitwiseOR(F.shiftrightunsigned("fp", edges[c]).bitwiseAND(F.lit((1 << wide) - 1).cast("long")))
        keys.append(key)
    return reps.select("fp", F.explode(F.array(*keys)).alias("shard"))


class Trees:
    """A forest of BK-trees, one for each unit: a node's children are keyed by their Hamming distance to it.

    Built level by level for all units at once: of the fingerprints that hang below a node at the same distance, the
    first becomes the child and the others go on below it.
    """

    def __init__(self, fps: np.ndarray, nodes: np.ndarray, unit: np.ndarray):
        """fps: all fingerprints, one word or a row of words each; nodes: those in trees, ordered by unit; unit: the unit of each node, 0 and up."""
        self.fps, self.words = fps, 1 if fps.ndim == 1 else fps.shape[1]
        self.bits = BITS * self.words
        units, first = np.unique(unit, return_index=True)
        self.root = np.full(int(unit.max()) + 1 if len(unit) else 0, -1, np.int64)
        self.root[units] = nodes[first]
        rest = np.ones(len(nodes), bool)
        rest[first] = False
        todo, above = nodes[rest], self.root[unit[rest]]
        keys, children = [], []
        while len(todo):
            key = above * (self.bits + 1) + self.apart(todo, above)
            got, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = todo[first]
            keys.append(got)
            children.append(child)
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, above = todo[rest], child[back[rest]]
        key, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which fingerprints differ."""
        d = np.bitwise_count(self.fps[a] ^ self.fps[b])
        return d.astype(np.int64) if d.ndim == 1 else d.sum(1, dtype=np.int64)

    def within(self, probes: np.ndarray, unit: np.ndarray, radius: int):
        """Yields (probe, node) arrays of fingerprints within the radius, following only edges within it of the node's distance."""
        at = self.root[unit]
        stack = [(probes[at >= 0], at[at >= 0])]
        while stack:
            probe, node = stack.pop()
            if len(probe) * self.words > FRONTIER:
                half = len(probe) // 2
                stack += [(probe[half:], node[half:]), (probe[:half], node[:half])]
                continue
            d = self.apart(probe, node)
            hit = (d <= radius) & (probe != node)
            if hit.any():
                yield probe[hit], node[hit]
            base = node * (self.bits + 1)
            low = np.searchsorted(self.key, base + np.maximum(d - radius, 0))
            wide = np.searchsorted(self.key, base + np.minimum(d + radius, self.bits), "right") - low
            if total := int(wide.sum()):
                ends = np.cumsum(wide)
                at = np.arange(total) + np.repeat(low - (ends - wide), wide)
                stack.append((np.repeat(probe, wide), self.child[at]))


def _link(table: pa.Table, radius: int) -> pa.RecordBatch | None:
    """Edges from each fingerprint to the smallest of its component within its unit."""
    cols = [table.column(c).to_numpy() for c in ("shard", "tree_no", "probe_no", "fp")]
    is_tree, is_probe = (table.column(c).to_numpy() for c in ("is_tree", "is_probe"))
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    is_tree, is_probe, fp = is_tree[order], is_probe[order], cols[3]
    new = np.zeros(len(fp), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
    unit = np.cumsum(new)
    alone = np.bincount(unit)[unit] == 1
    at = np.flatnonzero(is_tree & ~alone)
    ask = np.flatnonzero(is_probe & ~alone)
    if not len(at) or not len(ask):
        return None
    forest = Trees(fp.view(np.uint64), at, unit[at])
    roots = forest.root
    if len(roots) <= int(unit.max()):
        forest.root = np.concatenate((roots, np.full(int(unit.max()) + 1 - len(roots), -1)))
    parent = np.arange(len(fp))
    for probe, node in forest.within(ask, unit[ask], radius):
        parent = lowest(parent, probe, node)
    tied = np.flatnonzero(parent != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[parent[tied]])], names=["a", "b"])


def links(reps: DataFrame, n: int, scratch: Scratch, radius: int = 4, tree: int = TREE) -> DataFrame:
    """(a, b) of distinct fingerprints whose components are those of all pairs within the radius.

    Fingerprints within the radius share a shard (blocks of bits that agree). Each shard is a BK-tree that goes, with
    its probes, to one task; a shard of over `tree` fingerprints is cut into several trees that meet all its probes.
    Of a shard's pairs only a spanning forest leaves the task.
    """
    units = paired_units(shards(reps, *plan_blocks(n, radius)), ["shard"], "fp", tree, scratch)
    keys = ["shard", "tree_no", "probe_no"]

    def run(batches):
        for whole in groups_of(batches, keys):
            if (out := _link(whole, radius)) is not None and out.num_rows:
                yield out

    return units.select(*keys, "is_tree", "is_probe", "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    fingerprint: 16 hex digits; component_id: the smallest doc_id that links reach, itself included. Null texts and
    texts without words have fingerprint zero and link like any other. Repeated rows stay. Rows without a doc_id take
    part; a component of none but such rows has a null component_id. Further columns of docs are left out.
    """
    scratch = Scratch(spark, "simhash")
    fps = scratch.put(fingerprints(docs, width), "fps")
    reps = scratch.put(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    n = reps.count()
    roots = connected_components(links(reps.select("fp"), n, scratch, radius), "a", "b", scratch)
    rooted = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    found = with_least(rooted, "root", "least", "component_id", "fp", n, scratch, "least").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
