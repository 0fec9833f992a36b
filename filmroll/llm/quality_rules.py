"""Operator 9, quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation
over the counted vote patterns estimates how far each rule can be trusted, and
the posterior probability of a good document replaces a filter that asks every
rule to pass. A rule votes for a document only where what it sees speaks for good
prose (few symbols, a usual share of function words); most rules only ever
object, since a text without repeats may well be junk. Of an objector the
specificity is estimated, its sensitivity stays as it starts. None of the rules is
the base rule: their limits are stricter. The text is read once; what is kept of it is one narrow row per
document, from which patterns and verdicts follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.llm.common import SPACE, documents, materialize
from filmroll.llm.weak import fit_votes

#: Frequent function words of the corpus languages.
STOP_WORDS = "a al and as at avec be by da das de del den der des die dans du ein eine el en es est et for from han he il in is ist it la las le les los mit nicht of on or para pas por pour qu que se sich sie sont sur that the this to um un und une von was with y zu".split()

RULES = ("long_enough", "word_length", "few_symbols", "few_dup_lines", "few_repeats", "stop_words", "sentences")


def measure(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and the counts that the rules look at; null text counts as empty.

    Repeats are found in two steps: a hash of every 5-word window and the number
    of distinct ones; only texts where these differ sort their windows to find
    the places. Both are n log n in the text's words at most.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)])
    hashed = first.withColumn("windows", F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), window)).otherwise(F.array().cast("array<long>")))
    ordered = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    marked = hashed.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;]\W*$"))).cast("long").alias("n_closed_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size("windows") > F.size(F.array_distinct("windows")), ordered).alias("ordered"),
    )
    repeated = F.filter("ordered", lambda x, i: F.coalesce(F.get("ordered", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("ordered", i + 1)["h"] == x["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.sequence(x["i"], x["i"] + 4)))))
    return marked.select("*", F.when(F.col("ordered").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words")).drop("ordered")


def vote(measured: DataFrame, low_symbols: float = 0.02, high_symbols: float = 0.1) -> DataFrame:
    """Add a vote column per rule and ``base_failed``."""
    n, lines = F.col("n_words"), F.col("n_lines")
    mean_length = F.try_divide(F.col("word_chars"), n)
    symbols, repeats = F.try_divide(F.col("n_symbols"), n), F.try_divide(F.col("n_repeat_words"), n)
    dup, closed = F.try_divide(F.col("n_dup_lines"), lines), F.try_divide(F.col("n_closed_lines"), lines)
    stops = F.try_divide(F.col("n_stop_words"), n)
    either = lambda good, bad: F.when(good, 1).when(bad, 0)
    return measured.withColumns(
        {
            "base_failed": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
            "long_enough": F.when(n < 20, 0),
            "word_length": F.when((mean_length < 2.5) | (mean_length > 14.0), 0),
            "few_symbols": either(symbols < low_symbols, symbols > high_symbols),
            "few_dup_lines": F.when(dup > 0.3, 0),
            "few_repeats": F.when(repeats > 0.1, 0),
            "stop_words": either(stops >= 0.15, (stops < 0.06) & (n >= 40)),
            "sentences": F.when(closed < 0.1, 0),
        }
    )


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Quality of every row of ``docs`` (doc_id, text; other columns are ignored).

    Adds to the counts of :func:`measure` and the votes: ``base_failed``,
    ``posterior`` (probability of a good document) and ``kept`` (posterior at
    least ``threshold`` and not base_failed). Null or empty text has no words
    and fails; very long texts are taken whole, in n log n of their words;
    repeated rows each get a row; an empty table gives no rows.
    """
    voted = vote(materialize(measure(docs))).withColumn("votes", F.array(*RULES))
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n"))
    posterior = fit_votes(patterns, len(RULES)).posterior(F.col("votes"))
    return voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and weak-supervision verdict of every document."""
    return score_quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
