"""URL filters by association rules (operator 9).

Labelled URLs become sets of tokens; FP-growth mines the combinations that occur often
enough, and those under which pages are blocked clearly more often than on the whole, and more
often than chance explains for any of so many combinations, are rules. A rule is
listed in an inverted index under its rarest token; a URL meets the rules of its own tokens
and is blocked if one of them holds in full. Given host and path rules come first. All
of it is DataFrame work.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from clinote.session import store

MIN_SUPPORT, MIN_LIFT, MIN_PAGES = 0.002, 1.5, 5
#: How likely one false rule or more may be where labels have nothing to do with URLs.
CHANCE = 0.01
BLOCKED = "label=block"


def host(url: str) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: str) -> Column:
    """Distinct tokens: labels of the host, steps and ending of the path (numbers as ``#``), keys of the query."""
    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), p))

    steps = F.split(F.regexp_replace(F.lower(path(url)), r"\d+", "#"), r"/")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(F.lower(query), "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    found = F.concat(
        tagged("scheme:", F.array(scheme)), tagged("host:", F.split(host(url), r"\.")),
        tagged("path:", steps), tagged("query:", keys),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def _same_rows(rows: DataFrame, least: int) -> list[str]:
    """Frequent tokens that stand in exactly the same rows as a smaller one.

    Told by the number of the rows and the sum of their hashes. A row has few tokens, so few are frequent.
    """
    marked = rows.withColumn("row", F.xxhash64("items").cast("decimal(38,0)"))
    held = marked.select("row", F.explode("items").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.sum("row").alias("rows")
    ).filter(F.col("n") >= least)
    classes = held.groupBy("n", "rows").agg(F.array_sort(F.collect_set("token")).alias("tokens")).filter(F.size("tokens") > 1)
    return [t for r in classes.collect() for t in r["tokens"][1:] if t != BLOCKED]


def surprise(confidence: Column, base: float, pages: Column) -> Column:
    """Lower bound of -ln of the chance of such a confidence at the base rate (Chernoff), 0 where it is not above."""
    p = F.least(confidence, F.lit(1.0))
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / F.lit(1 - base))).otherwise(0.0)
    return F.when(p > base, pages * (p * F.log(p / F.lit(base)) + rest)).otherwise(0.0)


def mine(
    labelled: DataFrame, *, url: str = "url", blocked: str = "blocked", min_support: float = MIN_SUPPORT,
    min_confidence: float = 0.0, min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES, chance: float = CHANCE,
) -> DataFrame:
    """``rule_id, antecedent, confidence, support, rarest``: token combinations that imply a blocked page.

    ``labelled`` has a URL and a boolean. Rows without either teach nothing, and neither
    does an empty table, nor one in which all or none are blocked: no rules. A rule needs the support of
    ``min_pages`` blocked pages at least, and ``min_lift`` times the share of blocked pages as its
    confidence (``min_confidence`` asks for more); and its pages must be blocked so often that by chance, among all
    combinations mined, one such rule or more turns up with a probability below ``chance``. It is left out when one with
    fewer of its tokens is as confident. All figures are exact counts over all labelled rows.

    Tokens that stand in exactly the same rows say the same: the smallest stands for all of them, so a site whose
    URLs share many tokens does not give every combination of these.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select(
        F.concat(tokens(url), F.when(F.col(blocked), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>")))
        .alias("items")
    )
    rows = store(spark, rows.filter(F.size("items") > 0), "url-items")
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.array_contains("items", BLOCKED)).alias("blocked")).first()
    n, base = seen["n"], seen["blocked"] / max(1, seen["n"])
    if not 0 < base < 1:
        return spark.createDataFrame(
            [], "rule_id string, antecedent array<string>, confidence double, support double, rarest string"
        )
    support = min(1.0, max(min_support, min_pages / n))
    needless = _same_rows(rows, max(1, int(support * n)))
    if needless:
        rows = rows.withColumn("items", F.array_except("items", F.array(*[F.lit(t) for t in needless])))
    confidence = min(1.0, max(min_confidence, min_lift * base))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    itemsets = store(spark, model.freqItemsets, "url-itemsets")
    bound = -math.log(chance / max(1, itemsets.count()))
    pages = F.col("support") * n / F.col("confidence")
    wanted = (F.element_at("consequent", 1) == BLOCKED) & (surprise(F.col("confidence"), base, pages) >= bound)
    rules = model.associationRules.filter(wanted).select(
        F.sort_array("antecedent").alias("antecedent"), "confidence", "support"
    )
    rules = store(spark, rules.withColumn("rule_id", F.concat_ws(" ", "antecedent")), "url-rules")
    # A rule without one of its tokens is a rule as well; compare with those.
    shorter = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("less")).select(
        "rule_id", "confidence", F.concat_ws(" ", F.array_remove("antecedent", F.col("less"))).alias("shorter")
    )
    known = rules.select(F.col("rule_id").alias("shorter"), F.col("confidence").alias("reached"))
    beaten = shorter.join(known, "shorter").filter("reached >= confidence").select("rule_id").distinct()
    single = itemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = (
        rules.select("rule_id", F.explode("antecedent").alias("token")).join(single, "token")
        .groupBy("rule_id").agg(F.min(F.struct("freq", "token")).alias("least"))
        .select("rule_id", F.col("least.token").alias("rarest"))
    )
    return store(spark, rules.join(beaten, "rule_id", "left_anti").join(rarest, "rule_id"), "url-rules")


def given_rule(rules: Sequence[tuple[str, str, str]], host_column: str, path_column: str) -> tuple[Column, Column]:
    """The longest given ``(verdict, host, path)`` rule that fits, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, rule_host, rule_path in reversed(ordered):
        fits = ((F.col(host_column) == rule_host) | F.endswith(F.col(host_column), F.lit("." + rule_host))) & F.startswith(
            F.col(path_column), F.lit(rule_path)
        )
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decided).otherwise(verdict)
    return name, verdict


def judge(
    pages: DataFrame, mined: DataFrame, given: Sequence[tuple[str, str, str]] = (), *, key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``key, host, path, rule, verdict, mined_rule``: one row per page.

    The verdict is the given rule's; else ``block`` where a mined rule holds, the most
    confident one being named, and ``allow`` otherwise. A null URL is allowed by the mined
    rules. Rows that share a key are judged each by its own URL; rows without a key as well.
    """
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("url"))
    index = mined.select(F.col("rarest").alias("token"), "rule_id", "antecedent", "confidence")
    # Each URL once, and only tokens under which a rule is listed.
    urls = rows.select("url").filter(F.col("url").isNotNull()).distinct().withColumn("tokens", tokens("url"))
    met = urls.withColumn("token", F.explode("tokens")).join(index, "token")
    holds = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = holds.groupBy("url").agg(F.max(F.struct("confidence", "rule_id")).alias("best"))
    best = best.select("url", F.col("best.rule_id").alias("mined_rule"))
    placed = rows.withColumns({"host": host("url"), "path": path("url")})
    name, verdict = given_rule(given, "host", "path")
    return placed.join(best, "url", "left").select(
        key, "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_rule",
    )
