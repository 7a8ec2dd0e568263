"""SimHash near-duplicates of whole texts: five-word shingles, links where their sets have a Jaccard likeness of 0.8 or more.

Texts that are as like as that differ in about 0.15 of the bits of their fingerprints, 0.19 where they have a few
shingles. So fingerprints of 256 bits are looked up: no agreement on blocks is certain at that distance, and a shard is
the fingerprints that agree on some chosen bits, one shard for each of many choices (plan_tables). Each shard is a
BK-tree followed within NEAR bits, and the components of what it finds are groups. In a group, BK-trees of the first
64 bits are followed within RADIUS, and every pair found there that verified links do not already join is verified on
the shingles themselves. So a link is never wrong; README has the chance that one is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, arrow_map, connected_components, groups_of, lowest, paired_units, ragged, texts_of, tidy, with_least, words_of
from .simhash import BITS, TREE, Trees

#: Words of a shingle, and bits in which linked texts' fingerprints may differ.
WIDTH, RADIUS = 5, 26
#: Words of a wide fingerprint, and bits in which linked texts' may differ.
WORDS, NEAR = 4, 76
#: Evenly spread fingerprints that a shard holds at most.
SHARD = 256
#: Texts of a block of a large group; pairs with one text that meet in a task.
BLOCK, STAR = 256, 512
FLIP = np.random.default_rng(8).integers(0, 1 << 64, WORDS, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text as they come, and the n + 1 offsets of the texts in them.

    A-Z are lower-cased, words lie between ASCII white space; a text of fewer than WIDTH words is one shingle. Words are
    lower-cased one by one, since Arrow's ascii_lower misreads the texts of a sliced batch.
    """
    index, forms, first = words_of(texts)
    words = np.array([xxhash.xxh64_intdigest(f.encode().lower()) for f in forms], np.uint64)[index] if len(forms) else np.zeros(0, np.uint64)
    many = np.diff(first)
    counts = np.where(many < WIDTH, np.minimum(many, 1), many - WIDTH + 1)
    at, offsets = ragged(first[:-1], counts), np.concatenate(([0], np.cumsum(counts)))
    padded, h = np.concatenate((words, np.zeros(WIDTH, np.uint64))), np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        h = _mix(h + padded[at + k] + _ODD)
    for k in np.flatnonzero((many > 0) & (many < WIDTH)):
        h[offsets[k]] = xxhash.xxh64_intdigest(words[first[k] : first[k + 1]].tobytes(), seed=int(many[k]))
    return h, offsets


def nodes(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each text's sequence of shingles; 0 without words."""
    out, some = np.zeros(len(offsets) - 1, np.uint64), np.flatnonzero(np.diff(offsets))
    if len(some):
        place = ragged(np.zeros(len(some), np.int64), np.diff(offsets)[some]).astype(np.uint64)
        out[some] = _mix(np.add.reduceat(_mix(h + place * _ODD), offsets[some]))
    return out


def fingerprints(h: np.ndarray, offsets: np.ndarray, words: int = 1) -> np.ndarray:
    """The SimHash of each text's set of shingles: a bit is set if over half of them have it; 0 without words.

    Of several words the first is that of one word; the others are of other hashes of the shingles, a row a text.
    """
    out = np.zeros((len(offsets) - 1, words), np.uint64)
    for d, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        votes, own = np.zeros(BITS * words, np.int64), np.unique(h[a:b])
        for k in range(0, len(own), 1 << 14):
            some = own[k : k + (1 << 14)]
            many = np.column_stack([some, *(_mix(some ^ f) for f in FLIP[1:words])])
            votes += np.unpackbits(many.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[d] = np.packbits(2 * votes > len(own), bitorder="little").view(np.uint64)
    return out[:, 0] if words == 1 else out


def plan_tables(n: int) -> np.ndarray:
    """The bits that each shard's members agree on, a row a choice, for n fingerprints; a few fingerprints are one shard.

    More bits make smaller shards; as many more choices are made as fewer linked texts agree on them.
    """
    agree = max(0, (max(n, 1) - 1) // SHARD).bit_length()
    tables = int(np.ceil(15 / 0.85**agree)) if agree else 1
    rng = np.random.default_rng(agree)
    return np.array([rng.choice(BITS * WORDS, agree, replace=False) for _ in range(tables)], np.int64).reshape(tables, agree)


def shards(fps: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of each fingerprint its shard for each choice of bits: the choice and those bits."""
    out = np.repeat(np.arange(len(chosen))[None], len(fps), 0)
    for bits in chosen.T:
        out = 2 * out + ((fps[:, bits // BITS] >> (bits % BITS).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
    return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.view(np.int64)))


def text_hash(text: str = "text"):
    """A hash of a text; null is empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, fp, wide): texts of the same words have the same node; wide has the words of the fingerprint, none without words."""

    def each(batch):
        h, offsets = shingles(texts_of(batch, "text"))
        fps = fingerprints(h, offsets, WORDS)
        some = np.diff(offsets) > 0
        columns = [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(nodes(h, offsets).view(np.int64)), pa.array(np.ascontiguousarray(fps[:, 0]).view(np.int64)), _lists(fps[some].reshape(-1), np.where(some, WORDS, 0))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "fp", "wide"])

    return arrow_map(docs.select("doc_id", "text", text_hash().alias("text_hash")), each, "doc_id long, text_hash long, node long, fp long, wide array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles): the distinct shingles of each text, ascending."""

    def each(batch):
        h, offsets = shingles(texts_of(batch, "text"))
        sets = [np.unique(h[a:b]) for a, b in zip(offsets, offsets[1:])]
        return pa.RecordBatch.from_arrays([pa.array(nodes(h, offsets).view(np.int64)), _lists(np.concatenate(sets), np.array([len(s) for s in sets]))], names=["node", "shingles"])

    return arrow_map(docs.select("text"), each, "node long, shingles array<long>")


def _near(whole: pa.Table) -> pa.RecordBatch | None:
    """Of the units in a table sorted by node, too: a forest that spans what fingerprints within NEAR bits join.

    Its edges go to the least node of each tree, so shards that hold the same texts mostly send the same edges.
    """
    keys = np.column_stack([whole.column(c).to_numpy() for c in ("shard", "tree_no", "probe_no")])
    unit = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(1))))
    node, is_tree, is_probe = (whole.column(c).to_numpy() for c in ("node", "is_tree", "is_probe"))
    alone = np.bincount(unit)[unit] == 1
    at, ask = np.flatnonzero(is_tree & ~alone), np.flatnonzero(is_probe & ~alone)
    if not len(at) or not len(ask):
        return None
    forest = Trees(np.column_stack([whole.column(f"w{k}").to_numpy() for k in range(WORDS)]).view(np.uint64), at, unit[at])
    forest.root = np.concatenate((forest.root, np.full(int(unit[-1]) + 1 - len(forest.root), -1)))
    parent = np.arange(len(node))
    for probe, other in forest.within(ask, unit[ask], NEAR):
        parent = lowest(parent, probe, other)
    tied = np.flatnonzero(parent != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[parent[tied]])], names=["a", "b"])


def near_groups(reps: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(node, root): the components of the n fingerprints of reps(node, wide) that meet in a shard within NEAR bits; those alone are left out."""
    chosen = plan_tables(n)

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                fps = batch.column("wide").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("wide"), _lists(shards(fps, chosen).reshape(-1), np.full(len(fps), len(chosen)))], names=["node", "wide", "shards"])

    dealt = scratch.put(reps.where(F.size("wide") > 0).select("node", "wide").mapInArrow(tidy(each), "node long, wide array<long>, shards array<long>"), "dealt")
    rows = dealt.select("node", F.explode("shards").alias("shard"), *[F.col("wide")[k].alias(f"w{k}") for k in range(WORDS)])
    by = ["shard", "tree_no", "probe_no"]

    def run(batches):
        for whole in groups_of(batches, by, 1 << 14):
            if (out := _near(whole)) is not None and out.num_rows:
                yield out

    units = paired_units(rows, ["shard"], "node", TREE, scratch, "large")
    units = units.select(*by, "is_tree", "is_probe", "node", *[f"w{k}" for k in range(WORDS)]).repartition(*by).sortWithinPartitions(*by, "node")
    return connected_components(units.mapInArrow(tidy(run), "a long, b long").distinct(), "a", "b", scratch, "near")


def _verify(whole: pa.Table) -> pa.RecordBatch | None:
    """Of the units in a sorted table: links that join the components of each, each pair of components by one that holds.

    A unit's tree is asked for the fingerprints within the radius of its probes; pairs found are verified in order of
    the probes.
    """
    keys = np.column_stack([whole.column(c).to_numpy() for c in ("band", "tree_no", "probe_no")])
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
    node, root, fp, is_tree, is_probe = (whole.column(c).to_numpy() for c in ("node", "root", "fp", "is_tree", "is_probe"))
    out: list[tuple[int, int]] = []
    for lo, hi in zip(cuts, cuts[1:]):
        if len(np.unique(root[lo:hi])) < 2:
            continue
        at, ask = np.flatnonzero(is_tree[lo:hi]), np.flatnonzero(is_probe[lo:hi])
        if not len(at) or not len(ask):
            continue
        column = whole.column("shingles").slice(lo, hi - lo).combine_chunks()
        n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        starts, (forms, flat) = np.cumsum(n) - n, np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        label, has = root[lo:hi].copy(), np.zeros(len(forms), bool)
        tree = Trees(fp[lo:hi].view(np.uint64), at, np.zeros(len(at), np.int64))
        found = [np.column_stack(x) for x in tree.within(ask, np.zeros(len(ask), np.int64), RADIUS)]
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if keys[lo, 1] == keys[lo, 2]:  # tree and probes are the same texts: each pair once
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        pairs = pairs[5 * np.minimum(n[pairs[:, 0]], n[pairs[:, 1]]) >= 4 * np.maximum(n[pairs[:, 0]], n[pairs[:, 1]])]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        ends = np.flatnonzero(np.diff(pairs[:, 0], append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            p = int(pairs[a, 0])
            other = pairs[a:b, 1]
            other = other[label[other] != label[p]]
            if not len(other):
                continue
            own = flat[starts[p] : starts[p] + n[p]]
            has[own] = True
            common = np.add.reduceat(has[flat[ragged(starts[other], n[other])]], np.cumsum(n[other]) - n[other], dtype=np.int64)
            has[own] = False
            for q in other[9 * common >= 4 * (n[other] + n[p])]:  # common / (n + n - common) >= 0.8
                if label[q] != label[p]:
                    label[label == label[q]] = label[p]
                    out.append((node[lo + p], node[lo + q]))
    if not out:
        return None
    a, b = np.array(out, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])


def _stars(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): the links of each group's members with its least one, where RADIUS allows them. Pairs with one that has many are dealt to several tasks."""
    pairs = members.where("node <> low").select("node", "low", "fp")
    own = members.where("node = low").select("low", F.col("fp").alias("low_fp"))
    counts = pairs.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STAR)
    hot = scratch.put(counts.select("low", F.ceil(F.col("n") / STAR).cast("int").alias("chunks")), "centres")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    chunks = F.coalesce("chunks", F.lit(1))
    left = pairs.join(hot, "low", "left").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int"))
    left = left.select("low", "chunk", "node", "fp").join(sets.withColumnRenamed("shingles", "x"), "node")
    right = pairs.select("low").distinct().join(sets.select(F.col("node").alias("low"), F.col("shingles").alias("y")), "low").join(own, "low").join(hot, "low", "left")
    right = right.select("low", "low_fp", "y", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("low_fp"))) <= RADIUS
    like = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return left.join(right, ["low", "chunk"]).where(near & like).select(F.col("node").alias("a"), F.col("low").alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, root, component_id) for each row of docs(doc_id, text), all of which have a doc_id.

    component_id: the smallest doc_id that links of a Jaccard likeness of 0.8 or more reach, itself included; root tells
    components apart. Texts of the same words are one node; null texts and texts without words are node 0. Repeated
    rows stay.

    Shards of wide fingerprints make groups (near_groups). Members of a group are verified with its least one first.
    Groups that this leaves in several components become BK-trees, in blocks; pairs never leave a task, which sends
    links that join components.
    """
    scratch = Scratch(spark, "texts")
    rows = scratch.put(sketches(docs), "rows")
    reps = scratch.put(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("wide").alias("wide")), "reps")
    n = reps.count()
    groups = near_groups(reps, n, scratch)
    members = scratch.put(reps.select("node", "fp").join(groups, "node").select(F.col("root").alias("band"), F.col("root").alias("low"), "node", "fp"), "members")
    some = scratch.put(members.select("node").distinct().join(reps.select("node", "least"), "node"), "some")
    found = shingle_sets(docs.join(some.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sets = scratch.put(found.join(some.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    edges = scratch.put(_stars(members, sets, scratch), "stars")
    roots = connected_components(edges, "a", "b", scratch, "star")
    placed = members.join(roots, "node", "left").select("band", "node", "fp", F.coalesce("root", "node").alias("root"))
    placed = scratch.put(placed, "placed")
    open_ = placed.groupBy("band").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l <> h").select("band")
    units = paired_units(scratch.put(placed.join(open_, "band", "left_semi"), "open"), ["band"], "node", BLOCK, scratch).join(sets, "node")
    by = ["band", "tree_no", "probe_no"]

    def run(batches):
        for whole in groups_of(batches, by, 1 << 11):
            if (out := _verify(whole)) is not None:
                yield out

    units = units.select(*by, "is_tree", "is_probe", "node", "root", "fp", "shingles").repartition(*by).sortWithinPartitions(*by, "node")
    more = units.mapInArrow(tidy(run), "a long, b long")
    roots = connected_components(edges.union(more), "a", "b", scratch)
    rooted = reps.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = with_least(rooted, "root", "least", "component_id", "node", n, scratch, "least").select("node", "root", "component_id")
    return rows.select("doc_id", "text_hash", "node").join(found, "node").select("doc_id", "text_hash", "node", "root", "component_id")
