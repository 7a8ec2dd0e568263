"""Embedding near-duplicates through spherical-cap filters from structured random product codes.

A unit vector, less the corpus's mean, is turned and cut into two halves; each half has a random codebook of unit
vectors. A filter is one code of each half; its direction is the two codes side by side. A vector passes a filter if its
inner product with the direction reaches a threshold. List decoding finds all passed filters without going through the
product: the best code of the one half bounds which codes of the other can still reach. Vectors meet in the filters
that they share, and are compared as they are, without the mean taken off.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, groups_of, lowest, paired_units, ragged, with_least

#: Filters of a code that a vector passes on average, and at least (its best ones, if fewer reach the threshold), vectors
#: of a filter on average, vectors of one block of a large filter.
PASSED, FEWEST, IN_FILTER, BLOCK = 8, 4, 128, 512
#: Vectors that thresholds, mean and recall are taken from; pairs at the least cosine made of them; the share of those
#: that must meet; and independent codes: some directions are poor in one code, far fewer in several.
SAMPLE, TRIED, RECALL, CODES = 2048, 1024, 0.998, range(4, 13)
#: Pairs that are verified together.
PAIRS = 1 << 14
#: Scores, or sums of two, that list decoding looks at together.
DECODED = 1 << 21
#: What rounding of single precision may take from a cosine.
SLACK = 1e-5


class Code:
    """A product code for n vectors, with its threshold from a sample of them (unit length, in rows)."""

    def __init__(self, n: int, sample: np.ndarray, seed: int = 0):
        dims = sample.shape[1]
        rng = np.random.default_rng([seed, dims])
        self.size = math.ceil(math.sqrt(PASSED * n / IN_FILTER)) if n > IN_FILTER else 1
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.half = -(-dims // 2)
        books = [rng.standard_normal((d, self.size if d else 1)) for d in (self.half, dims - self.half)]
        self.books = [b / np.maximum(np.linalg.norm(b, axis=0), 1e-300) / math.sqrt(2) for b in books]
        self.filters = self.books[0].shape[1] * self.books[1].shape[1]
        self.least = -math.inf if self.filters <= FEWEST else self._threshold(sample[:512])

    def _threshold(self, sample: np.ndarray) -> float:
        """The inner product that PASSED filters of a sampled vector reach on average."""
        low, high = -1.0, 1.0
        step = max(16, self.step // 4)
        scores = [self._scores(sample[k : k + step]) for k in range(0, len(sample), step)]
        for _ in range(16):
            self.least = (low + high) / 2
            left = min(PASSED, self.filters / 2) * len(sample)
            for a, b in scores:
                if (left := left - self._reach(a, b, 2 * DECODED)) < 0:
                    break
            low, high = (self.least, high) if left < 0 else (low, self.least)
        return (low + high) / 2

    @property
    def step(self) -> int:
        """Vectors that are decoded together."""
        return max(16, DECODED // min(self.filters, 1 << 14))

    def _scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.turn
        return turned[:, : self.half] @ self.books[0], turned[:, self.half :] @ self.books[1]

    def _candidates(self, a: np.ndarray, b: np.ndarray):
        """(row, code) of each half that the best code of the other half can lift to the threshold; the number of pairs of them for each of the first."""
        left, right = np.nonzero(a >= self.least - b.max(1)[:, None]), np.nonzero(b >= self.least - a.max(1)[:, None])
        cuts = np.searchsorted(right[0], np.arange(len(a) + 1))
        return left, right, cuts[left[0]], np.diff(cuts)[left[0]]

    def _reach(self, a: np.ndarray, b: np.ndarray, most: int) -> int:
        """How many filters the vectors pass; at `most` pairs of codes or more, that number."""
        _, _, _, many = self._candidates(a, b)
        return most if many.sum() >= most else len(self._hits(a, b)[0])

    def _hits(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) that reach the threshold, by row."""
        (row, first), (_, second), start, many = self._candidates(a, b)
        if many.sum() > 2 * DECODED and len(a) > 1:
            half = len(a) // 2
            (r1, f1), (r2, f2) = self._hits(a[:half], b[:half]), self._hits(a[half:], b[half:])
            return np.concatenate((r1, r2 + half)), np.concatenate((f1, f2))
        i, j = np.repeat(np.arange(len(row)), many), ragged(start, many)
        row, first, second = row[i], first[i], second[j]
        ok = a[row, first] + b[row, second] >= self.least
        return row[ok], first[ok].astype(np.int64) * b.shape[1] + second[ok]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each vector passes, by row and filter; its FEWEST best if those are fewer."""
        a, b = self._scores(unit)
        row, found = self._hits(a, b)
        few = np.flatnonzero(np.bincount(row, minlength=len(unit)) < min(FEWEST, self.filters))
        if len(few):
            x, y = (np.argsort(-s[few], axis=1, kind="stable")[:, :FEWEST] for s in (a, b))
            sums = (np.take_along_axis(a[few], x, 1)[:, :, None] + np.take_along_axis(b[few], y, 1)[:, None, :]).reshape(len(few), -1)
            best = np.argsort(-sums, axis=1, kind="stable")[:, :FEWEST]
            own = np.take_along_axis((x[:, :, None].astype(np.int64) * b.shape[1] + y[:, None, :]).reshape(len(few), -1), best, 1)
            other = ~np.isin(row, few)
            row, found = np.concatenate((row[other], np.repeat(few, own.shape[1]))), np.concatenate((found[other], own.ravel()))
        order = np.lexsort((found, row))
        return row[order], found[order]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zeros stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


class Filters:
    """The codes for n vectors of which `sample` are some: as many as let pairs at the least cosine meet.

    Sampled vectors and others at the least cosine from them, in random directions, are decoded; codes are added until
    the share RECALL of the pairs meets. Where the last of CODES does not reach it, as for vectors that all lie close
    together, codes for fewer, larger filters are tried; with one filter every pair meets.
    """

    def __init__(self, n: int, sample: np.ndarray, least: float):
        unit = _unit(sample)
        self.mean = unit.mean(0) if n > IN_FILTER else np.zeros(sample.shape[1])
        rng = np.random.default_rng(n % (1 << 32))
        x = unit[np.resize(np.arange(len(unit)), TRIED)]
        away = rng.standard_normal(x.shape)
        away = _unit(away - (away * x).sum(1, keepdims=True) * x)
        y = least * x + math.sqrt(max(0, 1 - least * least)) * away
        x, y, centred = self.centred(x), self.centred(y), self.centred(unit)
        planned = n
        while True:
            self.codes, met = [], np.zeros(TRIED, bool)
            for k in range(CODES.stop - 1):
                code = Code(planned, centred, k)
                self.codes.append(code)
                for at in range(0, TRIED, code.step):
                    both = [code.decode(v[at : at + code.step]) for v in (x, y)]
                    keys = [row * code.filters + found for row, found in both]
                    met[at + np.intersect1d(*keys) // code.filters] = True
                self.recall = float(met.mean())
                if code.filters == 1 or (len(self.codes) >= CODES.start and self.recall >= RECALL):
                    return
                if len(self.codes) >= CODES.start and (1 - self.recall) ** ((CODES.stop - 1) / len(self.codes)) > 1 - RECALL:
                    break  # codes of this size would not do it
            planned //= 8

    def centred(self, unit: np.ndarray) -> np.ndarray:
        return _unit(unit - self.mean)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of the vectors x, by row and filter; filters are numbered one code after the other."""
        unit, rows, found, base = self.centred(_unit(x)), [], [], 0
        for code in self.codes:
            for k in range(0, len(unit), code.step):
                row, own = code.decode(unit[k : k + code.step])
                rows.append(row + k)
                found.append(own + base)
            base += code.filters
        row, found = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(row, kind="stable")
        return row[order], found[order]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows in double precision."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, and of finite components of which one is not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _with_filters(spark: SparkSession, classes: DataFrame, filters: dict[int, Filters]) -> DataFrame:
    """classes with `filters`, the filters that each passes, ascending."""
    names, shared = classes.columns, spark.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                for k in range(0, len(own), 2048):
                    some = batch.take(pa.array(own[k : k + 2048]))
                    row, found = shared.value[int(d)].decode(_matrix(some.column("vector")))
                    ends = np.searchsorted(row, np.arange(some.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], names=[*names, "filters"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, filters array<long>")


class _Lists:
    """The filters of each row of a unit, for asking which of two rows' common filters comes first."""

    def __init__(self, column: pa.Array):
        n = np.diff(np.asarray(column.offsets)).astype(np.int64)
        self.forms, self.flat = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.start = np.cumsum(n) - n
        self.row = np.repeat(np.arange(len(n)), n)
        self.keys = self.row * len(self.forms) + self.flat  # ascending

    def first(self, a: np.ndarray, b: np.ndarray, own: int) -> np.ndarray:
        """Whether `own` is the first filter that rows a and b have in common."""
        below = np.bincount(self.row[self.flat < np.searchsorted(self.forms, own)], minlength=len(self.start))[a]
        pair = np.repeat(np.arange(len(a)), below)
        asked = b[pair] * len(self.forms) + self.flat[ragged(self.start[a], below)]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.bincount(pair[self.keys[at] == asked], minlength=len(a)) == 0


def _verify(whole: pa.Table, least: float) -> pa.RecordBatch | None:
    """Of the units in a sorted table: rows (rep, other copies linked, null) and (rep, null, root within the unit)."""
    keys = np.column_stack([whole.column(c).to_numpy() for c in ("dims", "filter", "tree_no", "probe_no")]).astype(np.int64)
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
    rep, copies = whole.column("rep").to_numpy(), whole.column("copies").to_numpy()
    is_tree, is_probe = (whole.column(c).to_numpy() for c in ("is_tree", "is_probe"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo < 2:
            continue
        x = _matrix(whole.column("vector").slice(lo, hi - lo))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left, right = np.flatnonzero(is_tree[lo:hi]), np.flatnonzero(is_probe[lo:hi])
        same = keys[lo, 2] == keys[lo, 3]
        near = x[left].astype(np.float32) @ x[right].astype(np.float32).T >= least - SLACK
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        once = i < j if same else i != j
        i, j = i[once], j[once]
        if not len(i):
            continue
        lists = _Lists(whole.column("filters").slice(lo, hi - lo).combine_chunks())
        own, many = rep[lo:hi], copies[lo:hi]
        parent, n = np.arange(hi - lo), np.zeros(hi - lo, np.int64)
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            sure = np.einsum("nd,nd->n", x[a], x[b]) >= least
            a, b = a[sure], b[sure]
            parent = lowest(parent, a, b)
            first = lists.first(a, b, int(keys[lo, 1]))
            np.add.at(n, a[first], many[b[first]])
            np.add.at(n, b[first], many[a[first]])
        tied, some = np.flatnonzero(parent != np.arange(hi - lo)), np.flatnonzero(n)
        out.append((own[tied], np.full(len(tied), -1), own[parent[tied]]))
        out.append((own[some], n[some], np.full(len(some), -1)))
    if not out:
        return None
    rep, n, root = map(np.concatenate, zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n, mask=n < 0), pa.array(root, mask=n >= 0)], names=["rep", "n", "root"])


def fit(classes: DataFrame, least: float) -> dict[int, Filters]:
    """The filters for each number of dimensions of classes(k1, dims, vector), from about SAMPLE vectors of the least hashes of k1.

    The sample comes to the driver, a bounded number of rows for each number of dimensions.
    """
    counts = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, min(1 << 30, (SAMPLE << 30) // n))])
    rows = classes.where(F.pmod(F.xxhash64("k1"), F.lit(1 << 30)) < share[F.col("dims")]).select("k1", "dims", "vector").collect()
    found: dict[int, list] = {d: [] for d in counts}
    for r in sorted(rows, key=lambda r: r["k1"]):
        found[r["dims"]].append(r["vector"])
    # of few vectors none may be in the sample: any others do for a table that small
    return {d: Filters(n, np.array(found[d] or np.ones((1, d)), float), least) for d, n in counts.items()}


def near_duplicates(spark: SparkSession, vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding).

    n_links: other rows whose cosine, in double precision, is `least` or more and that share a filter (of pairs at just
    that cosine RECALL do, measured for the table's size and a sample of its vectors; closer ones do more surely);
    component_id: the smallest vec_id that links reach, itself included; kept: vec_id is component_id. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors link within their number of dimensions only. Equal vectors are one class that is compared once; repeated
    rows are copies. Rows of one vec_id with different vectors pool their links. Rows without a vec_id link too; their
    component_id is null where they reach no row that has one.
    Pairs never leave a task: it counts a pair in the first filter that both pass, and sends a spanning forest.
    """
    scratch = Scratch(spark, "caps")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    value = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0).cast(kind))  # no negative zero
    sound = vectors.select("vec_id", "embedding").where(usable(F.col("embedding"))).select("vec_id", value.alias("vector"))
    sound = sound.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), F.col("vector"))})
    classes = sound.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = scratch.put(classes.withColumn("rep", F.coalesce("least", "k1")).withColumn("dims", F.size("vector")), "classes")
    passed = scratch.put(_with_filters(spark, classes.select("dims", "rep", "copies", "vector"), fit(classes, least)), "passed")
    units = paired_units(passed.withColumn("filter", F.explode("filters")), ["dims", "filter"], "rep", BLOCK, scratch)
    keys = ["dims", "filter", "tree_no", "probe_no"]

    def run(batches):
        for whole in groups_of(batches, keys, 1 << 13):
            if (out := _verify(whole, least)) is not None and out.num_rows:
                yield out

    units = units.repartition(*keys).sortWithinPartitions(*keys, "rep")
    found = scratch.put(units.mapInArrow(run, "rep long, n long, root long"), "found")
    links = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("root is not null"), "rep", "root", scratch).withColumnRenamed("node", "rep")
    joined = classes.select("k1", "k2", "rep", "least", "copies").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    joined = with_least(joined, "root", "least", "component_id", "rep", classes.count(), scratch, "least").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = sound.select("vec_id", "k1", "k2").join(joined, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).select(F.col("vec_id").cast("long"), "n_links", F.col("component_id").cast("long"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
