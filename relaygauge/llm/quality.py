"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.llm.frames import VISIBLE_SPLIT, stage

REPEAT_WINDOW = 8  # fixed value: words of a window that counts as repeated
SYMBOLS = "#*$%&|<>"  # fixed value

# A text of fewer words, or with a larger share of repeated words, fails whatever others do.
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

STEP_BITS = 4  # a sketch has 2^4 steps per power of two: within 1/16 of a value
GROUP_ROWS = 100  # a language's source with fewer texts is judged by its language, and that by all
SPREADS = 4  # how many spreads beyond the inner quantiles a value may lie

# Rule: (value per text, smallest spread, whether a low value fails as well).  Shares are per thousand,
# word lengths in hundredths.
RULES = {
    "symbols": (lambda: 1000 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), 25, False),
    "dup_lines": (lambda: 1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), 120, False),
    "repeats": (lambda: 1000 * F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)), 75, False),
    "word_length": (lambda: 100 * F.col("word_chars") / F.greatest("n_words", F.lit(1)), 50, True),
}


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, n_words: Column, window: int = REPEAT_WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that stand twice or more in the text.

    Windows are compared by a 64-bit hash of their words; only where two are equal are they sorted
    with their places, so the work grows as n log n with the text.
    """

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(window)])

    hashes = F.transform(F.sequence(F.lit(0), n_words - window), hashed)

    def places(sorted_: Column) -> Column:
        same = F.filter(
            sorted_,
            lambda x, i: F.coalesce(F.get(sorted_, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(sorted_, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["at"]))

    def covered(at: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
        return F.aggregate(
            at,
            none,
            lambda done, p: F.struct(
                (done["n"] + p + window - F.greatest(p, done["upto"])).alias("n"), (p + window).alias("upto")
            ),
        )["n"]

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            covered(_once(F.sort_array(pairs), places))
        )

    return F.when(n_words <= window, F.lit(0)).otherwise(_once(hashes, count))


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words.  A null text has no words, symbols or lines."""
    kept = [F.col(c) for c in docs.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    split = docs.select(
        *kept,
        whole.alias("_text"),
        F.filter(F.split(whole, VISIBLE_SPLIT), lambda w: w != "").alias("_words"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(has_word)).alias("_lines"),
    )
    return split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words"), F.size("_words")).cast("long").alias("n_repeat_words"),
    )


def step_of(value: Column) -> Column:
    """The step of a sketch that a whole number of 0 or more falls in."""
    power = F.length(F.bin(value)) - 1 - STEP_BITS
    width = 1 << STEP_BITS
    above = F.floor(value / F.pow(F.lit(2), power))
    return F.when(value < width, value).otherwise(power * width + above).cast("long")


def step_floor(step: Column) -> Column:
    """The smallest value of a step."""
    width = 1 << STEP_BITS
    power = F.floor(step / width) - 1
    return F.when(step < 2 * width, step).otherwise((step - power * width) * F.pow(F.lit(2), power)).cast("long")


def quantile_sketches(measures: DataFrame, groups: list[str]) -> DataFrame:
    """(*groups, rule, step, n): sketches that merge by adding up, counted where rows are read."""
    values = F.array(
        *[F.struct(F.lit(name).alias("rule"), step_of(F.floor(value()).cast("long")).alias("step")) for name, (value, _, _) in RULES.items()]
    )
    return (
        measures.where("n_words > 0")
        .select(*groups, F.explode(values).alias("_v"))
        .groupBy(*groups, "_v.rule", "_v.step")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _limits(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(*groups, rule, n, low, high): what a text of the group may show."""
    merged = sketches.groupBy(*groups, "rule", "step").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*groups, "rule")
    upto = F.sum("n").over(by.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = merged.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(by))

    def quantile(q: float) -> Column:
        return step_floor(F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("step"))))

    table = placed.groupBy(*groups, "rule").agg(
        F.sum("n").alias("n"), quantile(0.1).alias("_q10"), quantile(0.5).alias("_q50"), quantile(0.9).alias("_q90")
    )
    least = F.create_map(*[part for name, (_, spread, _) in RULES.items() for part in (F.lit(name), F.lit(spread))])[F.col("rule")]
    low_too = F.col("rule").isin(*[name for name, (_, _, low) in RULES.items() if low])
    high = F.col("_q90") + SPREADS * F.greatest(F.col("_q90") - F.col("_q50"), least)
    low = F.col("_q10") - SPREADS * F.greatest(F.col("_q50") - F.col("_q10"), least)
    return table.select(*groups, "rule", "n", F.when(low_too, low).alias("low"), high.alias("high"))


def thresholds(measures: DataFrame, lang: str = "lang", source: str = "source", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(lang, source, limits): per rule the lowest and highest value allowed, a row per group.

    From the group's own sketch where it has ``group_rows`` texts, else from its language's, merged
    of its sources', else from all.
    """
    own = quantile_sketches(measures, [lang, source])
    fine, coarse, whole = (_limits(own, by) for by in ([lang, source], [lang], []))
    enough = lambda t: F.col(f"{t}.n") >= group_rows
    joined = (
        fine.alias("f")
        .join(coarse.alias("c"), F.col(f"f.{lang}").eqNullSafe(F.col(f"c.{lang}")) & (F.col("f.rule") == F.col("c.rule")))
        .join(whole.alias("w"), F.col("f.rule") == F.col("w.rule"))
    )
    chosen = F.when(enough("f"), F.struct("f.low", "f.high")).when(enough("c"), F.struct("c.low", "c.high")).otherwise(F.struct("w.low", "w.high"))
    return (
        joined.select(F.col(f"f.{lang}").alias(lang), F.col(f"f.{source}").alias(source), "f.rule", chosen.alias("_limit"))
        .groupBy(lang, source)
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "_limit"))).alias("limits"))
    )


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(``key``, measures, base_failed, failed, kept) for each row of ``docs``.

    ``failed`` names the rules whose value lies outside what the text's language and source allow; a
    text is kept if it fails none and not the base rule.  Measures are taken once and written to the
    shared folder, sketches are counted from them, and the limits join them again: a row per group, so
    Spark broadcasts it or splits a group that holds most rows.  Null languages and sources are groups
    of their own; a null text has no words and fails; repeated rows count as often as they stand there;
    other columns are not read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    measures = stage(text_measures(rows, "_text"), "quality")
    limits = thresholds(measures, "_lang", "_source")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))

    def fails(name: str) -> Column:
        value, limit = F.floor(RULES[name][0]()), F.col("limits")[name]
        return (value > limit["high"]) | F.coalesce(value < limit["low"], F.lit(False))

    failed = F.filter(F.array(*[F.when(fails(name), F.lit(name)) for name in RULES]), lambda x: x.isNotNull())
    joined = measures.alias("m").join(
        limits.alias("l"), F.col("m._lang").eqNullSafe(F.col("l._lang")) & F.col("m._source").eqNullSafe(F.col("l._source")), "left"
    )
    return joined.select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        failed.alias("failed"),
        (~base_failed & (F.size(failed) == 0)).alias("kept"),
    )
