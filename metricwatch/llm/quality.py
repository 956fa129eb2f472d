"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every text is judged in its own row; there is no shuffle and no user function. A null or empty text
has no words and fails the length rule. A text of any length costs n log n for the repeated windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import SPACE

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or re that the this to was were with "
    "au avec ce dans des du elle en est et il la le les ne pas par pour qui que sur un une "
    "als auf das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu "
    "al con de del el ella en es la las lo los no para por que se su un una y"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A measure must lie between `least` and `most`; a bound of None is open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# Shares are per word (symbols), per line with a word (lines) or per character in words (letters).
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", most=0.25),
    Rule("stop_words", "stop_word_ratio", least=0.02),
    Rule("capitals", "capital_ratio", most=0.3),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
)

def _covered(at: Column) -> Column:
    """Number of words covered by three-word windows that start at the sorted places `at`."""
    steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(3)))
    return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda total, step: total + step))


def with_measures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add the struct `name` with counts and ratios of each text.

    Repeated windows are found by sorting one long per window, its hash above its place: equal
    windows become neighbours, and neighbours with equal hash bits are compared word by word.
    The steps are separate projections so that nothing is computed per element of an array.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    q = lambda c: F.col(f"__q_{c}")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    tokens = F.when(F.length(bare) > 0, F.split(bare, SPACE + "+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\x0b\f\r"))) > 0)
    step = docs.select(*keep, body.alias("__q_body"), tokens.alias("__q_tokens"), lines.alias("__q_lines"))
    bits = F.ceil(F.log2(F.size(q("tokens")) + 2)).cast("int")  # as many as a place in this text needs
    step = step.select(
        "*", F.transform(q("tokens"), lambda w: F.xxhash64(w)).alias("__q_h"), F.array_join(q("tokens"), "").alias("__q_solid"),
        (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("__q_place"),
    )
    step = step.select("*", F.bitwise_not(q("place")).alias("__q_hash"))
    keys = F.transform(
        F.sequence(F.lit(0), F.size(q("h")) - 3),
        lambda i: F.xxhash64(q("h")[i], q("h")[i + 1], q("h")[i + 2]).bitwiseAND(q("hash")).bitwiseOR(i.cast("long")),
    )
    step = step.select("*", F.when(F.size(q("h")) > 3, F.sort_array(keys)).otherwise(F.array().cast("array<bigint>")).alias("__q_s"))

    def equal(a: Column, b: Column) -> Column:
        same = a.bitwiseAND(q("hash")) == b.bitwiseAND(q("hash"))
        i, j = a.bitwiseAND(q("place")).cast("int"), b.bitwiseAND(q("place")).cast("int")
        h = q("h")
        return same & (h[i] == h[j]) & (h[i + 1] == h[j + 1]) & (h[i + 2] == h[j + 2])

    again = F.filter(q("s"), lambda x, j: equal(x, F.get(q("s"), j + 1)) | equal(x, F.get(q("s"), j - 1)))
    step = step.select("*", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(q("place")).cast("int"))).alias("__q_at"))
    n_words, in_words = F.size(q("tokens")).cast("long"), F.length(q("solid")).cast("long")
    symbols, dup = F.regexp_count(q("body"), F.lit(f"[{SYMBOLS}]")).cast("long"), F.size(q("lines")) - F.size(F.array_distinct(q("lines")))
    stop = F.size(F.filter(q("tokens"), lambda w: F.lower(w).isin(STOP_WORDS)))
    capitals = F.length(F.regexp_replace(q("solid"), r"\P{Lu}+", ""))
    counts = {"n_words": n_words, "word_chars": in_words, "n_symbols": symbols, "n_dup_lines": dup.cast("long"),
              "n_repeat_words": _covered(q("at")).cast("long"), "n_stop_words": stop, "n_capitals": capitals, "n_lines": F.size(q("lines"))}
    step = step.select(*keep, *[c.alias(f"__q_{k}") for k, c in counts.items()])
    ratios = {"mean_word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_word_ratio": ("n_stop_words", "n_words"),
              "capital_ratio": ("n_capitals", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines")}
    return step.select(*[c for c, n in zip(keep, docs.columns) if n != name], F.struct(
        *[q(k).alias(k) for k in counts], *[F.try_divide(q(a), q(b)).alias(k) for k, (a, b) in ratios.items()]).alias(name))


def broken_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measures break; a ratio without a denominator breaks none."""
    checks = []
    for rule in rules:
        value, out = m[rule.measure], F.lit(False)
        if rule.least is not None:
            out = out | (value < rule.least)
        if rule.most is not None:
            out = out | (value > rule.most)
        checks.append(F.when(out, F.lit(rule.name)))
    return F.filter(F.array(*checks), lambda name: name.isNotNull())


def judge(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeated: float = 0.5
) -> DataFrame:
    """Add the struct `quality`: measures, `base_failed`, `broken` rule names and `kept`.

    Any other column passes through unchanged; a column of the input called `quality` is replaced.
    """
    judged = with_measures(docs, text, "quality")
    m = F.col("quality")
    failed = (m["n_words"] < least_words) | (m["n_repeat_words"] > most_repeated * m["n_words"])
    judged = judged.withColumn("quality", F.struct(m.alias("measures"), failed.alias("base_failed"), broken_rules(m, rules).alias("broken")))
    return judged.withColumn("quality", F.col("quality").withField("kept", ~F.col("quality.base_failed") & (F.size("quality.broken") == 0)))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their columns as they were.

    A plain filter would be pushed below the projections with all their expressions copied into it;
    a row that fails becomes no row in a generator instead.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kept = F.explode_outer(F.when(F.col("quality.kept"), F.array("row"))).alias("row")
    return judge(packed, **options).select(kept).where("row IS NOT NULL").select("row.*")
