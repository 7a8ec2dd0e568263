"""Secret scans through a ledger of blobs: each content is scanned once for each rule version."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A pattern's leftmost non-overlapping matches, of which those count whose group has `least` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which spans that start together are listed. In the second and third
#: the least length stands in the pattern: a run fails as a whole or not, so the matches are the same.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: A private key goes from BEGIN to the next END line. Without one, it goes on over header lines to the end of the last
#: long run of base64 that nothing but base64, white space and backslashes (of written line ends) comes before, with a
#: shorter last line and a checksum. Bodies are runs of one class, since Java goes a level deeper for each repeated group.
_LABEL = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_HEADERS = r"(?:[\x20\t\r\n]*[A-Za-z-]+: [^\n]*\n){0,64}"
_BODY = r"[A-Za-z0-9+/=\x20\t\r\n\\]*[A-Za-z0-9+/=]{20,}(?:\r?\n[A-Za-z0-9+/]{1,19}={0,2})?(?:\r?\n=[A-Za-z0-9+/]{4})?"
#: What this scan adds to them.
MORE = (
    Rule("private_key", 2, rf"-----BEGIN {_LABEL}(?:[\s\S]*?-----END {_LABEL}|{_HEADERS}{_BODY})?"),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", 1, r"[Bb]earer\x20{1,4}[A-Za-z0-9+/_.=-]{16,}"),
)


def blob_id(text: Column) -> Column:
    """The content's address; null is the empty content."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, kind, kind_no, start, end) of blobs(blob, text, todo): todo names the rules to apply to a blob.

    A text split at its matches gives the gaps before them; running sums of gaps and matches give code points. The sums
    are a window over a blob's own matches, so a text with very many of them costs no more than in proportion.
    """
    each = []
    for no, r in enumerate(rules):
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        groups = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else found
        checked = F.transform(groups, lambda g: F.length(g) >= r.least)
        parts = F.arrays_zip(
            F.transform(F.slice(F.split("text", r.pattern, -1), F.lit(1), F.size(found)), lambda g: F.length(g)).alias("gap"),
            F.transform(found, lambda m: F.length(m)).alias("wide"),
            checked.alias("counts"),
        )
        none = F.array().cast("array<struct<gap:int,wide:int,counts:boolean>>")
        parts = parts.cast("array<struct<gap:int,wide:int,counts:boolean>>")
        each.append(F.struct(F.lit(no).alias("kind_no"), F.lit(r.kind).alias("kind"), F.when(F.array_contains("todo", r.name) & F.col("text").rlike(r.pattern), parts).otherwise(none).alias("parts")))
    rows = blobs.select("blob", F.explode(F.array(*each)).alias("r")).where(F.size("r.parts") > 0)
    rows = rows.select("blob", "r.kind_no", "r.kind", F.posexplode("r.parts").alias("k", "m"))
    upto = Window.partitionBy("blob", "kind_no").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.wide")).over(upto)
    rows = rows.select("blob", "kind", "kind_no", "m", end.alias("end")).where("m.counts")
    return rows.select("blob", "kind", "kind_no", (F.col("end") - F.col("m.wide")).alias("start"), "end")


class Ledger:
    """What was scanned, kept in a folder that jobs come back to.

    A run is a subfolder of its own with three tables: paths (path, blob), every version that was shown to the ledger;
    findings (blob, kind, kind_no, start, end, rule); scanned (blob, rules). A run counts once its mark is there, which
    is written last: one that broke off leaves nothing that is read, and may be done again. Runs at the same time may
    scan a blob twice; findings are listed once.
    """

    MARK = "_DONE"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """The folders of the runs that are whole."""
        if not self._fs.exists(self._root):
            return []
        below = sorted(f.getPath().toString() for f in self._fs.listStatus(self._root) if f.isDirectory())
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        return [x for x in below if self._fs.exists(of(x, self.MARK))]

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self.runs()
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{r}/{name}" for r in found])

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rules array<string>")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, kind string, kind_no int, start long, end long, rule string").distinct()

    def paths(self) -> DataFrame:
        """(path, blob): each content that each path has ever had."""
        return self._read("paths", "path string, blob string").distinct()

    def located(self) -> DataFrame:
        """The findings in all versions of all paths."""
        return self.paths().join(self.findings(), "blob")

    def unseen(self, versions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """(blob, text, todo): each content of versions(blob, text) once, with the rules that it has not met.

        What was scanned is taken away before texts are shuffled.
        """
        names = F.array(*[F.lit(r.name) for r in rules])
        once = lambda df, *by: df.groupBy("blob", *by).agg(F.first("text").alias("text"))
        if not self.runs():
            return once(versions).withColumn("todo", names)
        met = self.scanned().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("met"))
        todo = versions.select("blob").distinct().join(met, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("met", F.array().cast("array<string>"))))
        return once(versions.join(todo.where(F.size("todo") > 0).select("blob", "todo"), "blob"), "todo")

    def add(self, versions: DataFrame, rules: Sequence[Rule]) -> None:
        """Scans what is new in versions(blob, text[, path]), and notes the paths."""
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        path = F.col("path").cast("string") if "path" in versions.columns else F.lit(None).cast("string")
        # ids alone are kept, no texts
        versions.select(path.alias("path"), "blob").distinct().write.parquet(f"{run}/paths")
        names = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.name)])
        scan(self.unseen(versions, rules), rules).withColumn("rule", names[F.col("kind")]).write.parquet(f"{run}/findings")
        seen = self.spark.read.parquet(f"{run}/paths").select("blob").distinct()
        seen.withColumn("rules", F.array(*[F.lit(r.name) for r in rules])).write.parquet(f"{run}/scanned")
        self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(run, self.MARK)).close()


def scan_documents(spark: SparkSession, docs: DataFrame, ledger: Ledger, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """Spans of docs(doc_id, text), the unseen ones scanned into the ledger, all joined back to every row with the content.

    (doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans): spans is `kind:start:end` by start, then rule order,
    joined by commas, in code points, end exclusive; base_sha256 is the SHA-256 of the base rules' list alone. Null
    texts are empty; texts without secrets have zeros, the hash of the empty string and no spans. Repeated rows and
    rows without a doc_id stay; further columns are left out.
    """
    versions = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ledger.add(versions.select(F.col("doc_id").alias("path"), blob_id(F.col("text")).alias("blob"), "text"), rules)
    order = {r.kind: k for k, r in enumerate(rules)}
    current = [r.name for r in rules]
    base = [r.kind for r in rules if r in BASE]
    rank = F.create_map(*[F.lit(x) for k, n in order.items() for x in (k, n)])
    found = ledger.findings().where(F.col("rule").isin(current))
    found = found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", rank[F.col("kind")].alias("no"), "kind", "end"))).alias("s"))
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = lambda *kinds: F.filter("s", lambda x: x["kind"].isin(*kinds))
    found = found.select("blob", *[F.size(own(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(listed(own(*base)), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))
    ids = versions.select("doc_id", blob_id(F.col("text")).alias("blob"))
    out = ids.join(found, "blob", "left")
    none = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in base} | {"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))}
    return out.withColumns(none).select("doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans", "blob")


def redact(docs: DataFrame, ledger: Ledger, column: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the findings of the ledger replaced in the text; overlapping spans are merged first.

    Rows and columns stay; a null text stays null, since it has no spans.
    """
    found = ledger.findings().select("blob", "start", "end").distinct()
    before = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
    found = found.withColumn("g", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("blob", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    joined = docs.withColumn("__blob", blob_id(F.col(column))).join(found.withColumnRenamed("blob", "__blob"), "__blob", "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("__spans.end"))
    gaps = F.transform("__spans", lambda x, i: F.substr(F.col(column), (F.get(starts, i) + 1).cast("int"), (x["start"] - F.get(starts, i)).cast("int")))
    tail = F.substr(F.col(column), (F.element_at(F.col("__spans.end"), -1) + 1).cast("int"))
    clean = F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(g, F.lit(mark))), ""), tail)
    return joined.withColumn(column, F.when(F.col("__spans").isNull(), F.col(column)).otherwise(clean)).select(*docs.columns)
