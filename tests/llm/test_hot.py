"""Keys that hold most rows are split; ledgers that several jobs come back to; models without labels; long words."""

import hashlib
import math
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, huffman, linededup, secrets, simhash_texts, sketch, toxicity, wordbpe

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def cold(monkeypatch):
    """Small bounds, so that small tables have hot keys."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "BUCKET_ROWS", 50)


def test_salted(spark, cold, tmp_path):
    rows = spark.createDataFrame([("hot" if k % 4 else f"k{k}", k) for k in range(4000)] + [(None, 1)], "key string, v long")
    scratch = common.Scratch(spark, "t")
    low = scratch.put(rows.groupBy("key").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")), "low")
    left, right = common.salted(rows, low, ["key"], ["v"], common.hot_bound(4000))
    most = left.groupBy("key", "__salt").count().agg(F.max("count")).first()[0]
    assert most < 2 * 50 and left.join(right, ["key", "__salt"]).count() == 4000
    got = {(r["key"], r.v): r.m for r in common.with_least(rows, "key", "v", "m", "v", 4001, scratch, "x").collect()}
    assert len(got) == 4000 and got["hot", 3999] == 1 and got["k8", 8] == 8
    for rows in (10, 10**6, 10**12):
        assert rows / common.hot_bound(rows) <= common.HOT_KEYS


def test_hubs(spark, cold):
    """Components whose root, and another node, have most of the edges."""
    rng = random.Random(1)
    pairs = [(0, k) for k in range(1, 900)] + [(5000, k) for k in range(800, 1700)] + [(k, k + 1) for k in range(6000, 6100)] + [(rng.randint(7000, 7300), rng.randint(7000, 7300)) for _ in range(150)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", common.Scratch(spark, "t")).collect()}
    nodes = sorted({x for a, b in pairs for x in (a, b) if a != b})
    at = {n: k for k, n in enumerate(nodes)}
    parent = common.lowest(np.arange(len(nodes)), *(np.array([at[p[i]] for p in pairs if p[0] != p[1]]) for i in (0, 1)))
    assert got == {n: nodes[parent[at[n]]] for n in nodes}


def test_few_shuffles_a_round(spark):
    """Without hubs a round of the components is three shuffles: the driver keeps account of each task of each."""
    plans = {}

    class Seen(common.Scratch):
        def put(self, df, name, codec="zstd"):
            plans[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
            return super().put(df, name, codec)

    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", Seen(spark, "t")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}
    assert len(plans) > 2 and all(n <= 3 for name, n in plans.items() if name != "cc-0"), plans


def test_rows_without_a_key(spark):
    """Small tables lose them as large ones do."""
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 8), (None, 1)], "key long, v long")
    got = sorted((r["key"], r.v, r.m) for r in common.with_least(rows, "key", "v", "m", "v", 4, common.Scratch(spark, "t"), "x").collect())
    assert got == [(1, 3, 3), (1, 5, 3), (2, 8, 8)]


def test_shards_send_edges_to_the_least(spark, monkeypatch):
    """The same from each shard, so that few edges are left and few rounds join them."""
    rng, seen = random.Random(4), {}
    words = [[f"w{rng.randrange(9000)}" for _ in range(300)] for _ in range(40)]
    texts = [" ".join([*w[:k], f"x{k}", *w[k + 1 :]]) for w in words for k in range(10, 20)]
    monkeypatch.setattr(simhash_texts, "connected_components", lambda edges, a, b, scratch, name="cc": seen.setdefault(name, edges) and common.connected_components(edges, a, b, scratch, name))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash_texts.near_duplicates(spark, docs).collect()}
    assert got == {k: k // 10 * 10 for k in range(400)}
    edges = [(r.a, r.b) for r in seen["near"].collect()]
    assert all(b < a for a, b in edges) and len(edges) <= 2 * 360


def test_the_driver_gives_back_what_fitting_took(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1))
    docs = spark.createDataFrame([(k, "vile" if k % 2 else "kind") for k in range(60)], "doc_id long, text string")
    toxicity.fit_labels(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert calls


def test_window_that_most_documents_share(spark, cold):
    rows = [(k, f"a{k}\nlicense one\nlicense two\nlicense three\nb{k}") for k in range(400)] + [(1000, "\n".join(["x", "y", "z"] * 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"a{k}\nb{k}" for k in range(1, 400)) and got[1000] == "x\ny\nz"


@pytest.mark.parametrize("hot", [None, 7])
def test_doc_id_that_most_rows_have(spark, cold, hot):
    """It fills several buckets; the file's order and the next documents are what they are without buckets."""
    rows = [(hot if k % 3 else 2 * k, f"{k:04d} text " + "word " * (k % 5)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bounds = common.id_bounds(docs)
    assert common.repeated_ids(bounds).tolist() == [common.LEAST if hot is None else hot]
    near = sketch.with_next(docs).groupBy("bucket").count().collect()
    assert max(r["count"] for r in near) < 200
    edit = lambda t, x: hashlib.sha256((t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode()).hexdigest()
    after = {edit(t, x): (j, k) for j, (_, t) in enumerate(rows) for k, (_, x) in enumerate(rows)}
    follows = dict(after[r.edited_sha256] for r in sketch.compare_edited(spark, docs).collect())
    k, walk = follows[0], [0]
    while k:
        walk.append(k)
        k = follows[k]
    assert sorted(walk) == list(range(900))  # one round through all documents, by descending doc_id
    at = [common.LEAST if rows[k][0] is None else rows[k][0] for k in walk]
    assert sum(a < b for a, b in zip(at, [*at[1:], at[0]])) == 1
    path = f"{common.Scratch(spark, 'hot').root}/f"
    huffman.write_ids(spark, docs, BPE, path)
    back = sorted(huffman.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d)) and [r.start for r in back] == np.cumsum([0, *[r.n_tokens for r in back]])[:-1].tolist()
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    assert max(r.n for r in parts) < 0.4 * sum(r.n for r in parts)
    ids, offsets = wordbpe.WordEncoder.load(BPE).encode(pa.array([t for _, t in rows], pa.large_string()))
    assert sorted(tuple(r.ids) for r in back) == sorted((*ids[a:b].tolist(), 2) for a, b in zip(offsets, offsets[1:]))


def test_long_words_are_not_kept():
    known = common.Known(1000)
    learn = lambda w: [len(w)] * (1 + len(w) % 3)
    rng = random.Random(2)
    for _ in range(30):
        forms = [f"{rng.randint(0, 900)}" * rng.choice([1, 2, 40, 60]) for _ in range(40)]
        forms = list(dict.fromkeys(forms))
        index = np.array([rng.randrange(len(forms)) for _ in range(100)])
        ids, n = known.ids(index, forms, learn)
        assert ids.tolist() == [x for i in index for x in learn(forms[i])] and n.tolist() == [len(learn(forms[i])) for i in index]
        assert all(len(w) <= common.LONG for w in known.place) and sorted(known.place.values()) == list(range(len(known.place)))


# ---------------------------------------------------------------- ledgers


def versions(spark, texts):
    return spark.createDataFrame([(p, t) for p, t in texts], "path string, text string").withColumn("blob", secrets.blob_id(F.col("text")))


def test_ledger_is_kept_in_its_folder(spark, tmp_path):
    path = str(tmp_path / "l")
    secrets.Ledger(spark, path).add(versions(spark, [("a", "token=abcdefgh1"), ("b", "none")]), secrets.BASE)
    again = secrets.Ledger(spark, path)
    later = versions(spark, [("a", "token=abcdefgh2"), ("b", "none"), ("c", "token=abcdefgh1")])
    assert [r.text for r in again.unseen(later, secrets.BASE).collect()] == ["token=abcdefgh2"]
    again.add(later, secrets.BASE)
    third = secrets.Ledger(spark, path)
    assert third.unseen(later, secrets.BASE).count() == 0 and len(third.runs()) == 2
    assert sorted((r.path, r.start, r.end) for r in third.located().collect()) == [("a", 0, 15), ("a", 0, 15), ("c", 0, 15)]
    assert third.paths().count() == 5 - 1  # b had one content
    newer = [*secrets.BASE[:2], secrets.Rule("hex", 2, "[0-9a-f]{40,}")]
    assert {tuple(r.todo) for r in third.unseen(later, newer).collect()} == {("hex@2",)} and third.unseen(later, newer).count() == 3


def test_runs_that_broke_off(spark, tmp_path, monkeypatch):
    """Whatever was written before the mark does not count, and is scanned again."""
    path, rows = str(tmp_path / "l"), [("a", "token=abcdefgh1")]
    ledger = secrets.Ledger(spark, path)
    monkeypatch.setattr(secrets.Ledger, "MARK", "no/such/../.\0")
    with pytest.raises(Exception):
        ledger.add(versions(spark, rows), secrets.BASE)
    monkeypatch.undo()
    again = secrets.Ledger(spark, path)
    assert again.runs() == [] and again.findings().count() == 0 and again.unseen(versions(spark, rows), secrets.BASE).count() == 1
    again.add(versions(spark, rows), secrets.BASE)
    assert secrets.Ledger(spark, path).findings().count() == 1 and again.unseen(versions(spark, rows), secrets.BASE).count() == 0


# ---------------------------------------------------------------- toxicity


def plain_score(text, model):
    """Sentence by sentence, word by word."""
    clean, quiet = 1.0, 0.0
    lines = [re.findall(r"[^ \t\n\x0b\x0c\r]+", x) for x in text.split("\n")]
    sentences, held = [], []
    for k, words in enumerate(lines):
        for w in words:
            held.append(w)
            if w.endswith((".", "!", "?")):
                sentences.append(held)
                held = []
        if k + 1 < len(lines):
            if held or not sentences:
                sentences.append(held)
                held = []
            # the end of a line goes with the sentence before it
    if held:
        sentences.append(held)
    for s in sentences:
        w = sum(sum(float(model.weights[f]) for f in toxicity.features(x)) for x in set(s))
        p = 1 / (1 + math.exp(-(model.bias + w)))
        if model.bias + w < toxicity.QUIET:
            quiet -= math.log(1 - p)
        else:
            clean *= 1 - p
    return 1 - clean * math.exp(-quiet / (1 + quiet / toxicity.LIMIT))


def test_scores_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit_labels(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = [r for r in toxicity.score_documents(spark, docs, model).collect() if "\n\n" not in (r.text or "") and (r.text or "").strip()]
    assert len(rows) > 50 and any(r.score > 0.5 for r in rows)
    for r in rows:
        assert r.score == pytest.approx(plain_score(r.text, model), rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_nothing_to_learn_from(spark, toxic):
    """No labels, or labels of one kind: no text is toxic, however long it is."""
    docs = spark.createDataFrame([(k, "The river runs. " * (10_000 if k == 3 else 150)) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, toxic) for k in range(12)], "doc_id long, toxic int")
    got = toxicity.score_documents(spark, docs, toxicity.fit_labels(docs, labels)).collect()
    assert max(r.score for r in got) < 1e-9 and all(r.predicted == 0 for r in got)


def test_long_harmless_texts(spark):
    rng = random.Random(0)
    plain = lambda: " ".join(rng.choice(["tree", "river", "stone", "house", "cloud", "road"]) for _ in range(6))
    texts = [". ".join([plain(), f"{plain()} scum {plain()}" if k % 4 == 0 else plain(), plain()]) + "." for k in range(400)]
    model = toxicity.fit(texts, np.array([k % 4 == 0 for k in range(400)]))
    long = ". ".join(plain() for _ in range(200_000)) + "."
    got = {r.doc_id: r for r in toxicity.score_documents(spark, spark.createDataFrame([(1, long), (2, long + " you scum here.")], "doc_id long, text string"), model).collect()}
    assert got[1].predicted == 0 and got[2].predicted == 1 and got[1].n_sentences == 200_000


def test_tasks_give_memory_back(monkeypatch):
    """Before a task and after it, also where its rows are not all asked for."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("back"))
    run = common.tidy(lambda batches: (2 * x for x in batches))
    assert list(run(iter([1, 2, 3]))) == [2, 4, 6] and len(calls) == 2
    some = run(iter([1, 2, 3]))
    assert next(some) == 2 and len(calls) == 3
    some.close()
    assert len(calls) == 4


def test_start_and_end_of_a_task(spark):
    """Each task starts and ends its function once; rows are those of the batches."""
    seen = []

    def each(batch):
        return batch if seen == ["start"] else None

    rows = spark.createDataFrame([(k, "a b") for k in range(50)], "doc_id long, text string").repartition(4)
    out = common.arrow_map(rows, each, "doc_id long, text string", start=lambda: seen.append("start"), end=seen.clear)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(50))


HELD = """
import re, sys, threading, time
import numpy as np, public_tokenizers, pyarrow as pa
from quillon.llm import huffman, packing

class Rows:  # stands for a table: the task's function is taken as it is
    def select(self, *columns):
        return self
    def mapInArrow(self, task, schema):
        return task

path, rng, most = public_tokenizers.path("word_bpe_49k.json"), np.random.default_rng(5), [0]

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

def watch():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.005)

def batches():
    for k in range(3):
        words = rng.integers(0, 26**4, 2_000_000)
        letters = (words[:, None] // 26 ** np.arange(4) % 26 + 97).astype(np.uint8)
        flat = np.concatenate((letters, np.full((len(words), 1), 32, np.uint8)), 1).tobytes().decode()
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": [flat[2000 * i : 2000 * i + 2000] for i in range(5000)]})

task = packing.pieces(Rows(), path, 1, 2048) if sys.argv[1] == "packing" else huffman.token_ids(Rows(), path, 2)
ready = list(batches())
threading.Thread(target=watch, daemon=True).start()
before = held()
rows = sum(b.num_rows for b in task(iter(ready)))
print(rows, most[0] - before)
"""


@pytest.mark.parametrize("query", ["packing", "token ids"])
def test_a_task_that_tokenizes_holds_little(query):
    """30 MB of text with over 400,000 distinct words: what a worker takes on top of it while it encodes."""
    out = subprocess.run([sys.executable, "-c", HELD, query], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True).stdout
    rows, most = map(int, out.split())
    assert rows >= 15_000 and most < 190
