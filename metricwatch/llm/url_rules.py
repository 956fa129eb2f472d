"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a pattern over an address, which is host and path of a URL without scheme, query and
fragment. In a pattern `*` stands for any characters and `^` for one separator (no letter, digit or
any of `_ - . %`) or the end; `||` in front ties it to the start of the host or of one of its labels,
`|` in front or behind to the start or the end. Everything else stands for itself.

A token is a run of ASCII letters and digits. A token of a pattern that is bounded on both sides is a
token of every address the pattern fits. So each rule is indexed once, under the one of its bounded
tokens that the fewest addresses have; the tokens of an address fetch candidate rules, and only for
those a regular expression runs. Rules without a bounded token are candidates of every address.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricwatch.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"(?:[^0-9A-Za-z_.%-]|$)"
INDEX_BYTES = 8 << 20  # rules with their expressions that are sent to every executor; more are shuffled


class Rule(NamedTuple):
    name: str
    pattern: str
    verdict: str  # allow or block
    level: int = 0  # a rule of a higher level wins, then the longer pattern


def host_rule(name: str, verdict: str, level: int = 1) -> Rule:
    """`host/path` as a rule that fits the host and its subdomains where the path starts with the rule's."""
    return Rule(name, f"||{name}", verdict, level)


# Hosts and paths that give no text worth reading: advertisement, link farms, forms and downloads.
DEFAULT_RULES = tuple(
    Rule(p, p, "block")
    for p in ("||ads.", "||ads-track.", "||spam-farm.", "||casino.", "-casino.", "/login^", "/cart^", "/checkout^", "/wp-admin/", ".zip|", ".exe|", "/feed/*/rss^")
)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return lowered(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(address: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(lowered(address), "[^0-9a-z]+"), lambda t: t != ""))


def expression(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    front = F.when(pattern.startswith("||"), F.lit(r"^(?:[^/]*\.)?")).when(pattern.startswith("|"), F.lit("^")).otherwise(F.lit(""))
    inner = F.regexp_replace(pattern, r"^\|{1,2}", "")
    end = F.when(inner.endswith("|"), F.lit(r"\z")).otherwise(F.lit(""))
    body = F.regexp_replace(F.regexp_replace(inner, r"\|$", ""), r"([\\.+?(){}\[\]$|])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("^"), F.lit(SEPARATOR)), F.lit("*"), F.lit("(?s:.*)"))
    return F.concat(front, body, end)


def bounded_tokens(pattern: Column) -> Column:
    """Tokens of a pattern with a character, separator or anchor on both sides; `*` and open ends bound nothing."""
    return F.array_distinct(F.regexp_extract_all(lowered(pattern), F.lit("(?<=[^0-9a-z*])([0-9a-z]+)(?=[^0-9a-z*])"), 1))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """`(name, pattern, verdict, level)` of a list of rules."""
    return spark.createDataFrame([tuple(r) for r in rules], "name string, pattern string, verdict string, level int")


def hits(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """`(host, path, name, pattern, verdict, level)`: the winning rule of each distinct address that some rule fits."""
    rules = stored(
        rules.where("pattern IS NOT NULL").dropDuplicates()
        .withColumns({"regex": expression(F.col("pattern")), "own": bounded_tokens(F.col("pattern"))})
        .withColumn("own", F.when(F.size("own") > 0, F.col("own")).otherwise(F.array(F.lit(""))))
    )
    size = rules.agg(F.sum(F.length("regex") + F.length("pattern") + F.length("name") + 64), F.max(F.array_contains("own", ""))).first()
    small = F.broadcast if (size[0] or 0) <= INDEX_BYTES else lambda df: df
    words = tokens(F.concat("host", "path"))
    # the empty token stands for rules that have none: every address has it if there is such a rule
    pairs = addresses.select("host", "path", F.explode(F.concat(words, F.array(F.lit(""))) if size[1] else words).alias("token"))
    wanted = rules.select(F.explode("own").alias("token")).distinct()
    counts = pairs.join(small(wanted), "token").groupBy("token").agg(F.count("*").alias("seen"))
    rarest = (
        rules.withColumn("token", F.explode("own")).join(counts, "token", "left")
        .groupBy("name", "pattern", "verdict", "level", "regex").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("least"))
        .where("least.seen > 0").withColumn("token", F.col("least.token")).drop("least")
    )
    fits = pairs.join(small(stored(rarest)), "token").where(F.expr("concat(host, path) RLIKE regex"))
    order = F.struct("level", F.length("pattern"), F.col("verdict") == "allow", "pattern", "name")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("name", "pattern", "verdict", "level"), order).alias("best"))
    return best.select("host", "path", "best.*")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """The rows of `pages` with a struct `judged(host, path, name, pattern, verdict, level)`.

    The winner among the rules that fit is the one of the highest level, then with the longest
    pattern, then an allowing one. Rows that no rule fits have the verdict `otherwise` and null name,
    pattern and level. A null url, or one without `://`, has an empty host and path and is judged like
    any other address. Repeated rows are all returned; addresses are judged once each.
    """
    if "judged" in pages.columns:
        raise ValueError("the pages already have a column judged")
    host_, path_ = host(F.col(f"`{url}`")), path(F.col(f"`{url}`"))
    addresses = stored(pages.select(host_.alias("host"), path_.alias("path")).distinct())
    found = hits(addresses, rules)
    found = found.select(*[F.col(c).alias(f"__judged_{c}") for c in found.columns])
    rows = pages.withColumns({"__host": host_, "__path": path_})
    joined = rows.join(found, (F.col("__host") == F.col("__judged_host")) & (F.col("__path") == F.col("__judged_path")), "left")
    judged = F.struct(
        F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__judged_name").alias("name"), F.col("__judged_pattern").alias("pattern"),
        F.coalesce("__judged_verdict", F.lit(otherwise)).alias("verdict"), F.col("__judged_level").alias("level"),
    )
    return joined.select(*[pages[c] for c in pages.columns], judged.alias("judged"))
