from pyspark.sql import functions as F

from metricwatch.llm import decontam
from metricwatch.llm.decontam import INSIDE, NAME, NUMBER

ODD = [
    "a 1.5, 2:3/4.5 Bob Smith. x) Ann,  Cy; Di 12,3.4. \u0663.\u0664 \U0001d7ce.\U0001d7cf x.5 5.x 1.,2 \u00e9 \u00c9a \u00df \u0160a \u00c1b 1..2 3 .4 5. 6  Zed (Al) q\tMo",
    "", None, " Lead 7", "7.7 Yo Al 9.9", "\u0130stanbul in \u0130zmir, \u01c5a \u01c5b 12km 3 km", "A B Cd  Ef\n Gh, Ij ", "plain",
]


def looking_back_first(text):
    """The tokens by the patterns that look back at every character."""
    t = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + INSIDE, "   ")
    t = F.regexp_replace(t, r"(?<=\p{Nd})[.,:/](?=\p{Nd})", INSIDE)
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{Nd},;)]\x20)(?=\p{Lu}\p{Ll})", NAME)
    t = F.regexp_replace(t, rf"\p{{Nd}}[\p{{Nd}}{INSIDE}]*", f" {NUMBER}$0 ")
    t = F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{Nd}}{NAME}{NUMBER}{INSIDE}]+", " ")
    return F.filter(F.split(t, " "), lambda w: w != "")


def test_tokens_equal_those_of_patterns_that_look_back_first(spark):
    texts = spark.createDataFrame([(t,) for t in ODD], "text string").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))
    assert texts.where(~decontam.typed(F.col("text")).eqNullSafe(looking_back_first(F.col("text")))).isEmpty()


def test_value_hashes_are_made_for_windows_by_value_only(spark):
    rows = spark.createDataFrame([(["a"] * 9,)], "__t array<string>")
    plan = decontam._windows(rows, [8])
    assert "__x" not in plan.columns  # a hash of every token's value
    assert [w.n for w in plan.first()["__w"]] == [8, 8]
