"""URL rules indexed by their rarest literal token.

A rule is a host suffix and a path prefix with an action.  Its literals (host labels, path
segments) are tokens; it is indexed under the one that fewest URLs contain.  The tokens of
a URL fetch candidate rules, and regular expressions run on those pairs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairflow.llm.common import ascii_lower
from pairflow.operators.sizing import measured

DEFAULT_VERDICT = "allow"
RULE_SCHEMA = "rule string, action string"


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def literal_tokens(host: Column, path: Column) -> Column:
    """Distinct ``h:label`` and ``p:segment`` tokens.  Segments count as far as a slash ends them, as a prefix may end within one."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    closed = F.regexp_extract_all(path, F.lit(r"([^/]+)(?=/)"), F.lit(1))
    return F.array_distinct(F.concat(labels, F.transform(closed, lambda x: F.concat(F.lit("p:"), x)), F.array(F.lit(""))))


def quoted(c: Column) -> Column:
    """A literal as a regular expression."""
    return F.regexp_replace(c, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")


def compile_rules(rules: DataFrame) -> DataFrame:
    """rule, action, tokens, host_re, path_re; rows without a rule or action are left out, repeated ones count once."""
    host, path = ascii_lower(F.regexp_extract("rule", r"(?s)^([^/]*)", 1)), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    return (
        rules.select("rule", "action")
        .dropna()
        .distinct()
        .select(
            "rule",
            "action",
            literal_tokens(host, path).alias("tokens"),
            F.when(host == "", F.lit("")).otherwise(F.concat(F.lit(r"(^|\.)"), quoted(host), F.lit(r"\z"))).alias("host_re"),
            F.concat(F.lit("^"), quoted(path)).alias("path_re"),
        )
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule, verdict.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the
    rule's.  The longest fitting rule wins; of equally long ones blocking ones, then the
    first by code point.  Without one, rule is null and the verdict is ``default``.  A null
    URL, or one without ``://``, has an empty host and path.  Repeated rows and ids each
    come back.  No pages or no rules: no rows, or the default for all.  Other columns are
    not read.  Counts token frequencies and measures the rules in jobs when called.
    """
    parsed = pages.select(
        pages[id_col].alias("page_id"),
        pages[url].alias("url"),
        F.coalesce(url_host(pages[url]), F.lit("")).alias("host"),
        F.coalesce(url_path(pages[url]), F.lit("")).alias("path"),
    )
    targets = parsed.select("host", "path").distinct().withColumn("token", F.explode(literal_tokens(F.col("host"), F.col("path"))))
    compiled = compile_rules(rules)
    used = measured(compiled.select(F.explode("tokens").alias("token")).distinct())
    # every URL has the empty token, so a rule without literals is a candidate for all
    counts = targets.join(used, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = compiled.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    indexed = ranked.groupBy("rule", "action", "host_re", "path_re").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    )
    hits = targets.join(measured(indexed), "token").filter(
        F.expr("rlike(host, host_re)") & F.expr("rlike(path, path_re)")
    )
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("l"), (F.col("action") != "block").alias("a"), "rule", "action")).alias("best")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
