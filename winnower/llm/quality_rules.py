"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame operations only.

Every text gets integer measures; a base rule (too few words, too many repeated words) fails some texts
outright. For the others each measure is sketched per language and source: a sketch is a table of counts
by value bucket, exact below 512 and within 1/256 above (nine leading bits), so that partial sketches from
any number of tasks merge by adding counts, in any order, to the same result.

A text is kept if every measure lies within a fence around the quartiles of its group, ``fence`` times their distance
to either side. No measure has limits of its own: a measure that is 0 for more than half of all texts is
sketched over its other values, and the quartiles' distance counts as one bucket at least, the resolution of the sketch.
Small groups lean on larger ones: the quartiles of a language are averaged with those of all texts, and a group's with
its language's, weighted by the number of texts against ``prior``. A measure that is 0 for all texts rejects none. The thresholds are
then joined to the texts' measures; the texts themselves are never shuffled.

Defined results: a null or wordless text has zero measures and fails the base rule; a null language or
source is a group like any other; rows that repeat are judged each on its own; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnower.llm.shared import settle

#: Leading bits that a bucket of the sketches keeps.
BITS = 9
SPACES = r"[\x20\x09-\x0D]+"
#: Measures of the fences: code points in a hundred words; letters in a thousand code points of words (ASCII letters and all
#: that isn't ASCII); and symbols, equal lines and repeated words in a thousand words.
MEASURES = ("word_length", "letters", "symbols", "dup_lines", "repeats")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    fence: int = 5
    prior: int = 50


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeated_words(words: Column, window: int) -> Column:
    """Number of words that lie in windows found at least twice in the array; windows are told apart by 64-bit hashes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = bound(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(window), F.get(at, k + 1) - p)).otherwise(window))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def doubled(rows: Column) -> Column:
        same = lambda k, other: F.coalesce(F.get(rows, k)["h"] == F.get(rows, other)["h"], F.lit(False))
        return F.filter(F.transform(rows, lambda r, k: F.when(same(k, k - 1) | same(k, k + 1), r["i"])), lambda p: p.isNotNull())

    def count(found: Column) -> Column:
        rows = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = bound(rows, lambda r: bound(F.sort_array(doubled(r)), covered))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), repeated).otherwise(0)

    return F.when(F.size(words) > window, bound(windows, count)).otherwise(0)


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, lang, source and the integer measures of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("words", text_words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return base.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[\x00-@\[-`{-\x7F]+", "")).cast("long").alias("n_letters"),
        dup.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), rules.window).cast("long").alias("n_repeat_words"),
    )


def bucket(v: Column) -> Column:
    """The lower end of the value's bucket: the value with all but its leading bits cleared."""
    shift = F.length(F.bin(v)) - BITS
    return F.when(v < 2**BITS, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one sketch per group and measure."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES))
    return measured.select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merged to ``keys`` and measure: q1, q3 (null without a value that counts) and n, the number of values that count."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"below": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    at = lambda q: F.min(F.when((F.col("below") * 4 >= F.col("total") * q) & (F.col("total") > 0), F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("n"))


def fences(sketch: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(t_lang, t_source, measure, lo, hi) for every group and measure of a sketch; null limits if nothing counts anywhere."""
    sparse = sketch.groupBy(F.col("measure").alias("m")).agg((F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)) * 2 > F.sum("n")).alias("sparse"))
    counted = sketch.join(F.broadcast(sparse), F.col("measure") == F.col("m"))  # a row for each measure
    counted = counted.select("lang", "source", "measure", "bucket", F.when(F.col("sparse") & (F.col("bucket") == 0), 0).otherwise(F.col("n")).alias("n"))
    named = lambda df, tag: df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    own, lang, whole = named(quartiles(counted, ["lang", "source"]), "o"), named(quartiles(counted, ["lang"]), "g"), named(quartiles(counted, []), "a")
    blend = lambda q, n, above: F.coalesce(F.call_function("div", q * n + above * rules.prior, n + rules.prior), above)
    table = lang.join(F.broadcast(whole), F.col("g_measure") == F.col("a_measure"))
    table = table.select("g_lang", "g_measure", *(blend(F.col(f"g_{q}"), F.col("g_n"), F.col(f"a_{q}")).alias(f"g_{q}") for q in ("q1", "q3")))
    table = own.join(table, F.col("o_lang").eqNullSafe(F.col("g_lang")) & (F.col("o_measure") == F.col("g_measure")))
    table = table.select("o_lang", "o_source", "o_measure", *(blend(F.col(f"o_{q}"), F.col("o_n"), F.col(f"g_{q}")).alias(q) for q in ("q1", "q3")))
    spread = rules.fence * F.greatest(F.col("q3") - F.col("q1"), F.call_function("div", F.col("q3"), F.lit(2 ** (BITS - 1))), F.lit(1))
    return table.select(F.col("o_lang").alias("t_lang"), F.col("o_source").alias("t_source"), F.col("o_measure").alias("measure"), (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))


def with_measures(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds base_failed and the measures of the fences."""
    per = lambda top, by, unit: F.coalesce(F.call_function("div", F.col(top) * unit, F.nullif(F.col(by), F.lit(0))), F.lit(0).cast("long"))
    return measured.withColumns({
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        "word_length": per("word_chars", "n_words", 100),
        "letters": per("n_letters", "word_chars", 1000),
        "symbols": per("n_symbols", "n_words", 1000),
        "dup_lines": per("n_dup_lines", "n_words", 1000),
        "repeats": per("n_repeat_words", "n_words", 1000),
    })


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of ``docs`` (doc_id, text, lang, source)."""
    base = settle(with_measures(measure(docs, rules), rules))
    sketch = settle(sketches(base.where(~F.col("base_failed"))))
    limits = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{e}_{m}") for m in MEASURES for e in ("lo", "hi")]
    table = fences(sketch, rules).groupBy("t_lang", "t_source").agg(F.lit(True).alias("t_known"), *limits)
    joined = base.join(table, base.lang.eqNullSafe(F.col("t_lang")) & base.source.eqNullSafe(F.col("t_source")), "left")
    fine = F.col("t_known")
    for m in MEASURES:
        fine = fine & F.coalesce(F.col(m).between(F.col(f"lo_{m}"), F.col(f"hi_{m}")), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"))
