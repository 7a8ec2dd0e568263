"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The Bloom filter has blocks of eight 32-bit words, in each of which a key sets one bit. It has about BITS bits for a
#: listed URL and at most MOST_BLOCKS blocks (64 MB), whatever the list's size: a fuller filter passes more URLs on.
WORDS, BITS, MOST_BLOCKS = 8, 12, 1 << 21


class Rule(NamedTuple):
    """Holds for a host and all its subdomains where the path begins so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The query's rules.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The host without a leading `www.`, and the path without its last slash; queries and fragments do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/$", ""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(name, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _place(key: Column, blocks: int) -> dict[str, Column]:
    """A key's block, and its bit in each word."""
    bits = F.xxhash64(F.lit(1), key)
    return {"__block": F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))} | {f"__w{k}": F.call_function("shiftleft", F.lit(1), F.shiftright(bits, 5 * k).bitwiseAND(F.lit(31).cast("long")).cast("int")) for k in range(WORDS)}


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(__block, __f0 .. __f7): the words of the blocks that have keys; at most `blocks` rows."""
    placed = keys.select(*[c.alias(n) for n, c in _place(F.col(key), blocks).items()])
    return placed.groupBy("__block").agg(*[F.bit_or(f"__w{k}").alias(f"__f{k}") for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of pages(page_id, url).

    The longest rule that fits decides; without one, a URL whose canonical form is in listed(url_key) is blocked and
    any other allowed. A key is looked up in one block of the Bloom filter, which is broadcast (its size is bounded);
    possible hits go on to a hash join with the list, so no other URL is ever blocked. Null and malformed URLs have an
    empty host and path and are allowed. Repeated rows, and rows without a page_id, stay; null keys of the list do not
    count; further columns are left out.
    """
    listed = listed.where("url_key is not null").select("url_key").distinct()
    blocks = int(min(MOST_BLOCKS, max(1, listed.count() * BITS // (32 * WORDS))))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), canonical(F.col("host"), F.col("path")).alias("key"))
    # decided rows and empty keys are not looked up: their block is none
    place = {n: F.when(F.col("r").isNull() & (F.col("key") != ""), c) for n, c in _place(F.col("key"), blocks).items()}
    rows = rows.withColumns(place).join(F.broadcast(bloom(listed, "url_key", blocks)), "__block", "left")
    passed = F.lit(True)
    for k in range(WORDS):
        passed = passed & (F.col(f"__f{k}").bitwiseAND(F.col(f"__w{k}")) == F.col(f"__w{k}"))
    rows = rows.select("page_id", "host", "path", "r", F.when(passed, F.col("key")).alias("url_key"))
    hits = rows.where("url_key is not null").join(listed.withColumn("found", F.lit(True)).hint("shuffle_hash"), "url_key", "left")
    rows = hits.unionByName(rows.where("url_key is null").withColumn("found", F.lit(None).cast("boolean")))
    found = F.coalesce("found", F.lit(False))
    return rows.select("page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.verdict", F.when(found, "block").otherwise("allow")).alias("verdict"), found.alias("listed"))


def feed_list(pages: DataFrame) -> DataFrame:
    """(url_key): the canonical URLs of pages that were reached through a feed (`utm_source=feed` in the query)."""
    rows = pages.where(F.contains("url", F.lit("utm_source=feed"))).select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("url_key"))
    return rows.where("url_key <> ''")
