"""Suffix rules learned from the vocabulary, and the lexicon they give.

A term is cut into a stem of ``MIN_STEM`` letters or more and a suffix of up to
``MAX_SUFFIX``. If the stem with one of the plain ``ENDINGS`` is a term too, the pair
supports the rule suffix -> ending. Supports are grouped counts over stems (an
equi-join of cut terms with the vocabulary, no pairs within a stem); a rule needs
``MIN_SUPPORT`` stems, and of a suffix's rules the best supported one stays. A term's
lemma comes from its longest suffix whose rule leads to another term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast

MIN_STEM = 3
MAX_SUFFIX = 4
MIN_SUPPORT = 5
MAX_RULES = 200
ENDINGS = ("", "e", "y")


def cut_terms(terms: DataFrame) -> DataFrame:
    """(term, stem, suffix, ending, lemma) for every cut and plain ending."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(MAX_SUFFIX), F.length("term") - MIN_STEM))
    cut = terms.where(F.length("term") > MIN_STEM).select("term", F.explode(sizes).alias("n")).select(
        "term", F.expr("substring(term, 1, length(term) - n)").alias("stem"), F.expr("right(term, n)").alias("suffix"))
    ended = cut.select("*", F.explode(F.array(*[F.lit(e) for e in ENDINGS])).alias("ending"))
    return ended.where(F.col("suffix") != F.col("ending")).withColumn("lemma", F.concat("stem", "ending"))


def supported_cuts(terms: DataFrame) -> DataFrame:
    """The cuts whose lemma is a term as well."""
    return cut_terms(terms).join(terms.select(F.col("term").alias("lemma")), "lemma")


def suffix_rules(terms: DataFrame, min_support: int = MIN_SUPPORT, max_rules: int = MAX_RULES) -> DataFrame:
    """(suffix, ending, support): one rule per suffix, at most ``max_rules``."""
    counts = supported_cuts(terms).where(F.length("suffix") > F.length("ending")).groupBy("suffix", "ending").agg(
        F.count(F.lit(1)).cast("bigint").alias("support")).where(F.col("support") >= min_support)
    best = Window.partitionBy("suffix").orderBy(F.desc("support"), "ending")
    return (counts.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
            .orderBy(F.desc("support"), "suffix").limit(max_rules))


def learned_lexicon(terms: DataFrame, rules: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """(term, lemma) of the terms that a rule leads to another term; of a term's
    rules the one with the longest suffix."""
    rules_b, _ = bounded_broadcast(rules.select("suffix", "ending"), max_rules)
    led = supported_cuts(terms).join(rules_b, ["suffix", "ending"])
    return led.groupBy("term").agg(F.max_by("lemma", F.length("suffix")).alias("lemma"))
