"""Allow and block lists matched by short hashes of host suffixes and path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellzonal.llm.text import free_name

#: Hex digits of the digest that pages and rules are joined on.
PREFIX = 8
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(c: Column) -> Column:
    return F.translate(c, *LETTERS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty without a ``://``."""
    mark = F.locate("://", url)
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url"
) -> DataFrame:
    """pages with the columns host, path, rule and verdict in the place of their own such ones.

    rules: columns host, path, verdict (allow or block). A rule fits its host and all
    subdomains of it when the url's path starts with its path. The longest rule wins,
    then the one of the longer host, then block. Rules without a host, a path or a
    verdict are left out; without a rule the verdict is ``default`` and rule is null.
    Null urls and urls without ``://`` have an empty host and path and no rule.
    Repeated rows stay, and so do all other columns.

    Each different host and path is judged once, however many pages it has. The
    lengths that rules have bound how many expressions a url is expanded into.
    """
    known = rules.where("host is not null and path is not null and verdict is not null")
    known = known.select(
        lower(F.col("host")).alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).distinct()
    shapes = known.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    labels = F.array(*[F.lit(n) for n in sorted(shapes["labels"])]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in sorted(shapes["lengths"])]).cast("array<int>")

    host, path = host_and_path(F.col(url))
    seen = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()
    suffixes = F.transform(
        F.filter(labels, lambda n: n <= F.size(F.split("host", r"\."))),
        lambda n: F.array_join(F.slice(F.split("host", r"\."), -n, n), "."),
    )
    starts = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n)
    )
    tried = seen.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(starts))

    def digest(host: str, path: str) -> Column:
        # The line feed is in no host, so that the parts cannot be read otherwise.
        return F.sha2(F.concat(F.col(host), F.lit("\n"), F.col(path)), 256)

    tried = tried.withColumn("digest", digest("suffix", "start"))
    known = known.withColumn("rule_digest", digest("rule_host", "rule_path"))
    fits = tried.withColumn("short", F.substring("digest", 1, PREFIX)).join(
        known.withColumn("short", F.substring("rule_digest", 1, PREFIX)), "short"
    )
    fits = fits.where("digest = rule_digest")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"),
        F.length("rule_host").alias("host_length"),
        F.col("rule_verdict").alias("verdict"),
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # Names that no column of pages has.
    best_host, best_path, best_verdict = (
        free_name(n, pages.columns) for n in ("best_host", "best_path", "best_verdict")
    )
    best = best.select(
        F.col("host").alias(best_host),
        F.col("path").alias(best_path),
        F.col("best.rule").alias("rule"),
        F.col("best.verdict").alias(best_verdict),
    )
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    marked = pages.select(*own, host.alias("host"), path.alias("path"))
    joined = marked.join(
        best, (F.col("host") == F.col(best_host)) & (F.col("path") == F.col(best_path)), "left"
    )
    verdict = F.coalesce(best_verdict, F.lit(default))
    return joined.select(*own, "host", "path", "rule", verdict.alias("verdict"))
