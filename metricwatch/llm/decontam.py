"""Benchmark leaks by template windows: built-in expressions only.

Texts become typed tokens: numbers, names (capitalised words inside a sentence, not words in capitals) and units keep their
value but stand for a placeholder in the template; all else is lower-cased words. Windows of eight
template tokens are hashed and joined with those of the benchmark items. Windows that match on one
diagonal (same distance between document and item) form a passage, whose slots must be consistent:
one value of the item always stands for one value of the document; places where it does not are left out. So a question with other numbers
or names is caught, and text that merely has the same frame around mixed slots is not. Windows with
few words besides slots say little as templates; they match by their values instead, word for word.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricwatch.llm.common import by_ids, stored

WINDOW = 8
LITERALS = 4  # words of a full window that must not be placeholders; with fewer it matches by its values
MOSTLY = "2 * odd <= held AND 10 * odd <= all"  # inconsistent places that leave a passage as it is, but for themselves
BROADCAST_WINDOWS = 500_000  # item windows sent to every executor: some 100 bytes each
# Words for units; one stands for a unit where a number precedes it.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces gram grams kilogram "
    "kilograms ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week "
    "weeks month months year years km h mph kph c f k celsius fahrenheit degree degrees percent usd eur gbp dollar dollars euro euros cent "
    "cents kb mb gb tb hz khz mhz ghz w kw kwh v volt volts watt watts meter meters metre metres kilometer kilometers centimeter centimeters"
).split()
# Marks of a typed token; the private-use characters are taken out of the texts first.
NAME, NUMBER, INSIDE = "\ue000", "\ue001", "\ue002"


def typed(text: Column) -> Column:
    """The tokens of a text, names and numbers marked in front."""
    t = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + INSIDE, "   ")
    # the rare character comes first, what must stand before it is looked at only there
    t = F.regexp_replace(t, r"[.,:/](?=\p{Nd})(?<=\p{Nd}[.,:/])", INSIDE)
    t = F.regexp_replace(t, r"\x20(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{Nd},;)]\x20)", " " + NAME)
    t = F.regexp_replace(t, rf"\p{{Nd}}[\p{{Nd}}{INSIDE}]*", f" {NUMBER}$0 ")
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NAME}{NUMBER}{INSIDE}]+"), lambda w: w != "")


def _windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Add `__w` (explode it with explode_outer: explode pushes a filter with the whole expression below), the windows of the column `__t` of typed tokens: hash, place, size, and their tokens where some are slots."""
    rows = rows.withColumn("__m", F.transform("__t", lambda w: (
        F.when(w.startswith(NAME), NAME).when(w.startswith(NUMBER), NUMBER).otherwise(w))))
    rows = rows.withColumn("__m", F.transform("__m", lambda w, i: (
        F.when((F.get("__m", i - 1) == NUMBER) & w.isin(UNITS), F.lit("u")).otherwise(w))))
    rows = rows.withColumn("__h", F.transform("__m", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__l", F.transform("__m", lambda w: F.when(w.isin(NAME, NUMBER), 0).otherwise(1)))

    for n in sizes:  # literal words of each window
        rows = rows.withColumn(f"__c{n}", F.when(F.size("__l") >= n, F.transform(
            F.sequence(F.lit(0), F.size("__l") - n), lambda i: reduce(lambda a, b: a + b, [F.col("__l")[i + k] for k in range(n)]))).otherwise(F.array().cast("array<int>")))

    def of_size(n: int) -> Column:
        literal, floor = F.col(f"__c{n}"), min(LITERALS, n)

        def made(wanted: Column, mark: int, value: Callable[[Column], Column]) -> Column:
            at = F.filter(F.transform(literal, lambda c, i: F.when(wanted(c), i)), lambda i: i.isNotNull())
            return F.transform(at, lambda i: F.struct(
                F.xxhash64(F.lit(mark), *[value(i + k) for k in range(n)]).alias("h"), i.alias("at"), F.lit(n).alias("n"),
                F.when(literal[i] < n, F.slice("__t", i + 1, n)).alias("tokens")))

        # at the floor both ways: a name at the start of an item is a word there and may be none in a document
        # windows by their values are few, so their words are hashed there and not for every token
        return F.concat(made(lambda c: c >= floor, n, lambda i: F.col("__h")[i]),
                        made(lambda c: c <= floor, -n, lambda i: F.xxhash64(F.translate(F.col("__t")[i], NAME, ""))))

    return rows.withColumn("__w", F.concat(*[of_size(n) for n in sizes]) if len(sizes) > 1 else of_size(sizes[0]))


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`(doc_id, row, item_id, shift, tokens, item_tokens, slots, mixed_slots)`: matched diagonals.

    `slots` counts the item's slot values inside matched windows and `mixed_slots` those that stand
    for several values; of these, places with another value than the most frequent one (or the item's
    own, of equally frequent ones) are inconsistent. `tokens` counts the item tokens inside matched
    windows without such places or, where they are more than half of the slots or a tenth of the tokens, those
    in windows that have none (a slot that keeps the item's value is none there). `row` is a hash of the text. Items shorter than the window are matched as
    a whole; those of fewer than three tokens, null texts and rows without an id match nothing.
    Different texts of an id count each on its own, equal ones as one; items of equal text each count.
    """
    items = benchmark.select(F.col("item_id"), typed(F.col("text")).alias("__t")).where("item_id IS NOT NULL AND size(__t) >= 3")
    sizes = sorted(r[0] for r in items.select(F.least(F.size("__t"), F.lit(window))).distinct().collect())  # at most `window` numbers
    if not sizes:
        sizes = [window]
    item_windows = stored(
        _windows(items, sizes).select("item_id", F.size("__t").alias("item_tokens"), F.explode_outer("__w").alias("w"))
        .where((F.col("w.n") == window) | (F.col("w.n") == F.col("item_tokens")))
        .select("item_id", "item_tokens", F.col("w.h").alias("h"), F.col("w.at").alias("item_at"), F.col("w.tokens").alias("theirs"))
    )
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), typed(F.col("text")).alias("__t"))
    doc_windows = _windows(texts, sizes).select("doc_id", "row", F.explode_outer("__w").alias("w")).select(
        "doc_id", "row", F.col("w.h").alias("h"), F.col("w.at").alias("at"), F.col("w.n").alias("n"), F.col("w.tokens").alias("mine"))
    small = item_windows.count() <= BROADCAST_WINDOWS
    hits = doc_windows.join(F.broadcast(item_windows) if small else item_windows, "h")
    key = ["doc_id", "row", "item_id", "shift"]
    hits = stored(hits.select("doc_id", "row", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "item_tokens", "n", "mine", "theirs"))
    pairs = hits.select(*key, "item_tokens", "item_at", "mine", "theirs", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select(
        *key, "item_tokens", (F.col("item_at") + F.col("k")).alias("place"), F.get("mine", F.col("k")).alias("mine"), F.get("theirs", F.col("k")).alias("theirs"))
    slot = F.col("theirs").startswith(NAME) | F.col("theirs").startswith(NUMBER)
    places = stored(pairs.groupBy(*key, "item_tokens", "place").agg(F.max("mine").alias("mine"), F.max("theirs").alias("theirs")).withColumn(
        "slot", F.coalesce(slot, F.lit(False))))
    votes = places.where("slot").groupBy(*key, "theirs", "mine").agg(F.count("*").alias("n"))
    top = votes.groupBy(*key, "theirs").agg(F.count("*").alias("values"), F.max(F.struct("n", F.col("mine") == F.col("theirs"), "mine"))["mine"].alias("top"))
    odd = F.col("slot") & (F.col("mine") != F.col("top"))
    first = F.col("slot") & (F.col("place") == F.col("first"))
    top = top.join(places.where("slot").groupBy(*key, "theirs").agg(F.min("place").alias("first")), [*key, "theirs"])
    sums = stored(places.join(top, [*key, "theirs"], "left").groupBy(*key, "item_tokens").agg(
        F.count("*").alias("all"), F.count_if("slot").alias("held"), F.count_if(odd).alias("odd"), F.count_if(first).cast("int").alias("slots"),
        F.count_if(first & (F.col("values") > 1)).cast("int").alias("mixed_slots"),
        F.collect_set(F.when(odd & (F.col("mine") != F.col("theirs")), F.col("place"))).alias("bad")))
    # too many differ: only windows without an inconsistent place count
    frames = hits.join(sums.where(~F.expr(MOSTLY)).select(*key, "bad"), key).where(
        ~F.exists("bad", lambda p: (p >= F.col("item_at")) & (p < F.col("item_at") + F.col("n"))))
    clean = frames.select(*key, F.explode(F.sequence(F.col("item_at"), F.col("item_at") + F.col("n") - 1)).alias("place")).distinct().groupBy(*key).agg(F.count("*").alias("clean"))
    tokens = F.when(F.expr(MOSTLY), F.col("all") - F.col("odd")).otherwise(F.coalesce("clean", F.lit(0)))
    return sums.join(clean, key, "left").select(*key, tokens.cast("int").alias("tokens"), "item_tokens", "slots", "mixed_slots")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = 0.8, least_tokens: int = 13) -> DataFrame:
    """`(doc_id, item_id, tokens, item_tokens, share)`: documents that hold an item.

    Counted are the tokens of an item on diagonals, without inconsistent slots; a leak has `least_share`
    of the item or `least_tokens` tokens of it in one text.
    """
    found = passages(docs, benchmark, window).groupBy("doc_id", "row", "item_id", "item_tokens").agg(F.sum("tokens").alias("tokens"))
    found = found.groupBy("doc_id", "item_id", "item_tokens").agg(F.max("tokens").alias("tokens"))
    found = found.withColumn("tokens", F.least("tokens", F.col("item_tokens").cast("long")))
    share = F.col("tokens") / F.col("item_tokens")
    return found.withColumn("share", share).where((share >= least_share) | (F.col("tokens") >= least_tokens)).select(
        "doc_id", "item_id", "tokens", "item_tokens", "share")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they were."""
    return by_ids(docs, stored(leaks(docs, benchmark).select("doc_id").distinct()), "left_anti")
