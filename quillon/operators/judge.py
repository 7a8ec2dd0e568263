"""Two ledgers: whether the right passages were found, and whether the answer holds to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The sources of the two libraries.
LIBRARIES = {"A": ("cninfo", "szse", "sec", "samsung", "skhynix"), "B": ("fedreg", "ecfr", "govinfo")}


def library(source: Column) -> Column:
    return F.when(source.isin(*LIBRARIES["A"]), "A").when(source.isin(*LIBRARIES["B"]), "B")


def recall(specs: DataFrame, hits: DataFrame, query: str = "n", lib: Column | None = None) -> DataFrame:
    """(query, ok_must, ok_companies, ok_libs, ok_forbid, ok_from, ok_required, ok_recall) for each spec.

    must: each string in some hit's text; min_companies: distinct companies (the source where blank); need_lib: distinct
    sources of a library; forbid_lib: none of it; min_from_company: hits of companies that contain the name;
    require_companies: name and topic in the same hit. Specs that must fail pass. A spec without hits fails what it asks.
    """
    lib = library(F.col("source")) if lib is None else lib
    own = hits.select(query, "text", "company", "source", lib.alias("lib"))
    joined = specs.join(own, query, "left")
    counted = lambda m: F.transform(F.map_entries(m), lambda e: e)
    text, company = F.coalesce("text", F.lit("")), F.coalesce("company", F.lit(""))
    hit = joined.withColumns({
        "__must": F.transform(F.coalesce("must", F.array().cast("array<string>")), lambda m: F.contains(text, m)),
        "__req": F.transform(counted(F.coalesce("require_companies", F.create_map().cast("map<string,string>"))), lambda e: F.contains(company, e["key"]) & F.contains(text, e["value"])),
        "__from": F.transform(counted(F.coalesce("min_from_company", F.create_map().cast("map<string,int>"))), lambda e: F.contains(company, e["key"])),
        "__name": F.when(F.col("text").isNotNull(), F.coalesce(F.when(company != "", company), F.col("source"))),
    })
    each = hit.select(query, F.posexplode_outer("__must").alias("i", "yes")).groupBy(query, "i").agg(F.bool_or("yes").alias("yes")).groupBy(query).agg(F.coalesce(F.bool_and("yes"), F.lit(True)).alias("ok_must"))
    required = hit.select(query, F.posexplode_outer("__req").alias("i", "yes")).groupBy(query, "i").agg(F.bool_or("yes").alias("yes")).groupBy(query).agg(F.coalesce(F.bool_and("yes"), F.lit(True)).alias("ok_required"))
    wanted = specs.select(query, F.posexplode(F.map_entries(F.coalesce("min_from_company", F.create_map().cast("map<string,int>")))).alias("i", "e")).select(query, "i", F.col("e.value").alias("need"))
    got = hit.select(query, F.posexplode("__from").alias("i", "yes")).groupBy(query, "i").agg(F.count_if("yes").alias("got"))
    from_ok = wanted.join(got, [query, "i"], "left").groupBy(query).agg(F.bool_and(F.coalesce("got", F.lit(0)) >= F.col("need")).alias("ok_from"))
    sums = hit.groupBy(query).agg(
        F.count_distinct("__name").alias("companies"), *[F.count_distinct(F.when(F.col("lib") == k, F.col("source"))).alias(f"lib_{k}") for k in LIBRARIES]
    )
    out = specs.join(each, query).join(required, query).join(sums, query).join(from_ok, query, "left")
    have = F.create_map(*[x for k in LIBRARIES for x in (F.lit(k), F.col(f"lib_{k}"))])
    need = F.coalesce("need_lib", F.create_map().cast("map<string,int>"))
    checks = {
        "ok_companies": F.col("companies") >= F.coalesce("min_companies", F.lit(0)),
        "ok_libs": F.forall(F.map_entries(need), lambda e: F.coalesce(F.try_element_at(have, e["key"]), F.lit(0)) >= e["value"]),
        "ok_forbid": F.coalesce(F.try_element_at(have, F.col("forbid_lib")) == 0, F.lit(True)),
        "ok_from": F.coalesce("ok_from", F.lit(True)),
    }
    out = out.withColumns(checks)
    passed = F.col("ok_must") & F.col("ok_required") & F.col("ok_companies") & F.col("ok_libs") & F.col("ok_forbid") & F.col("ok_from")
    return out.select(query, "ok_must", "ok_companies", "ok_libs", "ok_forbid", "ok_from", "ok_required", (F.coalesce("must_fail", F.lit(False)) | passed).alias("ok_recall"))


def attribute_numbers(answers: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, number, seats): each fact-like number of answers(query, q, ans) and the 1-based seats of hits that have it.

    Numbers that the question has are left out; seats is empty for a number that no hit has. Numbers are compared
    without their commas, and shown as the answer first writes them.
    """
    said = answers.select(query, F.transform(T.value_numbers(F.col("q")), T.number_key).alias("asked"), F.posexplode(T.value_numbers(F.col("ans"))).alias("at", "number"))
    said = said.where(~F.array_contains("asked", T.number_key(F.col("number")))).groupBy(query, "number").agg(F.min("at").alias("at"))
    said = said.withColumn("key", T.number_key(F.col("number")))
    found = hits.select(query, F.col("seat"), F.explode(T.value_numbers(F.col("text"))).alias("x")).select(query, (F.col("seat") + 1).alias("seat"), T.number_key(F.col("x")).alias("key")).distinct()
    seats = found.groupBy(query, "key").agg(F.array_sort(F.collect_list("seat")).alias("seats"))
    return said.join(seats, [query, "key"], "left").select(query, "number", F.coalesce("seats", F.array().cast("array<bigint>")).alias("seats"))


def answer_domain(answers: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, domain): the answer without white space and the question, and the companies and sources of cited seats."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    own = F.when(bare(F.col("q")) == "", bare(F.col("ans"))).otherwise(F.replace(bare(F.col("ans")), bare(F.col("q")), F.lit("")))
    cited = answers.select(query, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("ans", F.lit("")), F.lit(T.CITATION), F.lit(1)), lambda x: x.cast("int")))).alias("n"))
    names = hits.select(query, (F.col("seat") + 1).alias("n"), bare(F.concat(F.coalesce("company", F.lit("")), F.coalesce("source", F.lit("")))).alias("name"))
    added = cited.join(names, [query, "n"]).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("a"))
    rows = answers.select(query, own.alias("own")).join(added, query, "left")
    return rows.select(query, F.concat("own", F.coalesce(F.array_join("a.name", ""), F.lit(""))).alias("domain"))


def judge_answers(answers: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, ok_answer, orphans, missing) of answers(query, q, ans, must_ans, must_fail).

    An answer that must fail has to say that nothing covers it, and name no price. Any other holds if each fact-like
    number is in some hit and each of must_ans in its domain.
    """
    numbers = attribute_numbers(answers, hits, query).where(F.size("seats") == 0).groupBy(query).agg(F.array_sort(F.collect_list("number")).alias("orphans"))
    rows = answers.join(answer_domain(answers, hits, query), query).join(numbers, query, "left").withColumn("orphans", F.coalesce("orphans", F.array().cast("array<string>")))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    missing = F.filter(F.coalesce("must_ans", F.array().cast("array<string>")), lambda w: ~F.contains(F.col("domain"), bare(w)))
    ans = F.coalesce("ans", F.lit(""))
    honest = F.contains(ans, F.lit(T.UNCOVERED)) & ~ans.rlike(T.PRICE)
    rows = rows.withColumn("missing", missing)
    return rows.select(query, F.when(F.coalesce("must_fail", F.lit(False)), honest).otherwise((F.size("orphans") == 0) & (F.size("missing") == 0)).alias("ok_answer"), "orphans", "missing")


def ledger(recalls: DataFrame, verdicts: DataFrame, query: str) -> DataFrame:
    """One row: how many questions pass on recall, on the answer, on both."""
    both = recalls.select(query, "ok_recall").join(verdicts.select(query, "ok_answer"), query)
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok_recall").alias("n_recall"), F.count_if("ok_answer").alias("n_answer"), F.count_if(F.col("ok_recall") & F.col("ok_answer")).alias("n_both"))
