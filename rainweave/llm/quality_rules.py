"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.llm.text import settled, spaced_words

WINDOW = 8

# fixed values: frequent function words of English, French, German and Spanish
STOP_WORDS = (
    "the of and to in a is that for it with as was on are be by this from at or an not "
    "le la les de des du et un une en est que qui dans pour par sur pas au avec ce "
    "der die das und ist von mit ein eine zu den im nicht auf sich auch für dem "
    "el los las y del que en un una es se por con para no al su"
)


@dataclass(frozen=True)
class Rule:
    """Reject where ``measure`` lies outside its bounds, for texts of ``at_least`` words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    at_least: int = 0


RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("repeated_words", "repeat_percent", high=30),
    Rule("word_length", "mean_word_length", low=1.5, high=40),
    Rule("symbols", "symbols_per_word", high=0.4),
    Rule("stop_words", "stop_percent", low=0.5, at_least=60),
    Rule("repeated_lines", "dup_line_percent", high=60),
    Rule("shouting_lines", "bang_line_percent", high=60),
)
BASE = ("few_words", "repeated_words")


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and one column per measure.

    Every step is a projection of Spark's own functions over the whole text. Only texts with a repeated
    window (found by counting distinct window hashes) sort their windows.
    """
    text = F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit(""))
    stop = [w for w in dict.fromkeys(STOP_WORDS.split())]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    split = base.select("row", spaced_words(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = split.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(!!\s+\S+){3}"))).cast("long").alias("n_bang_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        ).alias("windows"),
    )
    kept = [c for c in counted.columns if c != "windows"]
    placed = counted.select(
        *kept,
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("placed"),
    )

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1), F.get("placed", k + 1)
        return (x["h"] == before["h"]) | (x["h"] == after["h"])

    starts = F.sort_array(F.transform(F.filter("placed", repeated), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return placed.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).select(
        *kept, "n_repeat_words",
        (100 * F.col("n_repeat_words") / words).alias("repeat_percent"),
        F.when(F.col("n_words") > 0, F.col("word_chars") / words).alias("mean_word_length"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (100 * F.col("n_stop_words") / words).alias("stop_percent"),
        (100 * F.col("n_dup_lines") / lines).alias("dup_line_percent"),
        (100 * F.col("n_bang_lines") / lines).alias("bang_line_percent"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of ``measures`` fails, in the order of the table."""

    def failed(rule: Rule) -> Column:
        value, out = F.col(rule.measure), F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        return F.when(out & (F.col("n_words") >= rule.at_least), F.lit(rule.name))

    return F.array_compact(F.array(*[failed(r) for r in rules]))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """``row`` (all input columns), the measures, ``failed_rules`` and ``kept``.

    A NULL text counts as empty: it has no words and fails the word count. Repeated rows are judged
    one by one. Input columns are only inside ``row``, so no name can clash.
    """
    return settled(measures(docs, text_column).withColumn("failed_rules", verdict(rules)), "kept", F.size("failed_rules") == 0)
