"""Line dedup by content-defined line chunks, in DataFrame operations only.

Boundaries depend on content alone: a line with words ends a chunk if the rolling hash of the hashes of the last ``window`` lines
with words is 0 modulo ``divisor``, or if it is the last one. So a run of lines is cut alike wherever it stands, and lines put in
or taken out elsewhere don't shift its boundaries. Chunks don't overlap. They are compared in two levels:

1. Chunks of two or more lines with words, over all documents. One that stands before, by doc_id and place, makes
   all its lines go, and nothing inside it is looked at again.
2. What the chunks leave: the ends of a repeated run, which lie in chunks that hold other lines too, and runs that are shorter than a chunk.
   Every other chunk opens into its runs of two neighbouring lines, and every chunk into the two lines at its end boundary; a line
   of ``long_words`` words counts as a run by itself.

A line goes if it lies in a run of which an equal one stands before it; so the first of equal lines always stays, and of a run of one
line the first alone stays. The first of equal runs never lies in a chunk that goes (then an equal one would stand before it), so the second level may leave those out:
the lines that go are the same for every ``divisor``, which only says how much the first level settles. With ``divisor`` 1 it settles nothing.

Runs are compared by counts of their hashes (96 bits for chunks, 64 for pairs of lines), then those whose hash repeats byte by byte.

Defined results: a null text stays null; nothing is removed from a text without a repeated run; rows that
repeat a doc_id count as the same document, of which each keeps its first run; runs of different texts that share
a hash are told apart by their texts (if these are chunks, the first level is left out); a null doc_id is a document that comes first; other columns
pass through, but for those of the result's names; an empty table gives no rows.

Hot runs are counted by partial sums. Only texts that hold a repeated run are shuffled, once: the ids of the others are
known without them. While the ids fit a broadcast of bounded size, the rest of the texts pass by; beyond it all texts meet the decisions
in one shuffle join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnower.llm.quality_rules import bound
from winnower.llm.shared import is_small, settle, shared_path

SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Chunking:
    window: int = 2
    divisor: int = 4
    long_words: int = 50


def _n_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACES), ""))


def rolled(lines: Column, k: Column, window: int) -> Column:
    """The rolling hash, modulo 2^31-1, of the fields ``h`` of line ``k`` and the lines before it."""
    value = F.lit(0).cast("long")
    for back in reversed(range(window)):
        value = F.pmod(value * 31 + F.coalesce(F.when(k >= back, F.get(lines, k - back)["h"]), F.lit(0)), F.lit(2**31 - 1))
    return value


def line_chunks(text: Column, c: Chunking = Chunking()) -> Column:
    """array<struct>: the chunks of a text, with

    - begin, end: the numbers of their first and last line; inner: how many pairs of neighbouring lines with words lie inside;
    - h1, h2: hashes of their text;
    - at: the numbers of their lines with words, and that of the next chunk's first;
    - pairs: for each of these but the last the hash of the text from it to the next;
    - long: number and hash of each line of ``long_words`` words.
    """

    def chunks(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), _n_words(x).alias("n"), F.pmod(F.xxhash64(x), F.lit(2**31 - 1)).alias("h")))
        run = lambda a, b: F.array_join(F.slice(lines, a + 1, b - a + 1), "\n")

        def chunk(part: Column, inner: Column) -> Column:
            begin, end = F.get(part, F.lit(0))["i"], F.get(part, inner)["i"]
            pairs = F.transform(F.slice(part, F.lit(1), F.size(part) - 1), lambda x, q: F.xxhash64(run(x["i"], F.get(part, q + 1)["i"])))
            long = F.filter(F.slice(part, F.lit(1), inner + 1), lambda x: x["n"] >= c.long_words)
            long = F.transform(long, lambda x: F.struct(x["i"].alias("i"), F.xxhash64(run(x["i"], x["i"])).alias("h")))
            hashes = lambda t: F.struct(F.xxhash64(t).alias("h1"), F.hash(t).alias("h2"))
            whole = F.when(inner > 0, bound(run(begin, end), hashes))
            return F.struct(
                begin.alias("begin"), end.alias("end"), inner.alias("inner"), whole["h1"].alias("h1"), whole["h2"].alias("h2"),
                F.transform(part, lambda x: x["i"]).alias("at"), pairs.alias("pairs"), long.alias("long"),
            )

        def cut(w: Column) -> Column:
            last = F.size(w) - 1
            ends = lambda k: (k == last) | (F.pmod(rolled(w, k, c.window), F.lit(c.divisor)) == 0)
            cuts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: (k <= last) & ends(k))

            def between(b: Column) -> Column:
                def one(e: Column, j: Column) -> Column:
                    start = F.when(j > 0, F.get(b, j - 1) + 1).otherwise(F.lit(0))
                    return bound(F.slice(w, start + 1, e - start + 2), lambda part: chunk(part, e - start))

                return F.transform(b, one)

            return bound(cuts, between)

        return bound(F.filter(marked, lambda x: x["n"] > 0), cut)

    return bound(F.split(text, "\n", -1), chunks)


def _order(line: str) -> Column:
    """The order over all runs: by doc_id, then by the number of their first line."""
    doc = F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("decimal(20,0)")
    return (doc * F.lit(2**31).cast("decimal(12,0)") + F.col(line)).cast("decimal(38,0)")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and reread."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _repeated(runs: DataFrame, key: list[str]) -> DataFrame:
    """Hashes that stand more than once, as ``r_`` columns, and where the first stands."""
    counts = runs.groupBy(*key).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return settle(counts.where("n > 1").select(*(F.col(k).alias(f"r_{k}") for k in key), "first"))


def _near(rows: DataFrame, repeated: DataFrame, same: Column, how: str) -> DataFrame:
    return rows.join(F.broadcast(repeated) if is_small(repeated) else repeated, same, how)


def repeated_runs(docs: DataFrame, c: Chunking) -> DataFrame:
    """The runs of ``docs`` (doc_id, _row, text) whose hash stands more than once: coarse (the first level) or not, begin, end, hash, ord, gone."""
    each = docs.where("text is not null").select("doc_id", "_row", F.explode(line_chunks(F.col("text"), c)).alias("c"))
    chunks = _stored(each.select("doc_id", "_row", "c.*"), "line-chunks").withColumn("ord", _order("begin"))

    first = _repeated(chunks.where("inner > 0"), ["h1", "h2"])
    met = _near(chunks, first, (F.col("inner") > 0) & (F.col("h1") == F.col("r_h1")) & (F.col("h2") == F.col("r_h2")), "left")
    met = met.withColumn("gone", F.coalesce(F.col("ord") != F.col("first"), F.lit(False))).drop("r_h1", "r_h2")
    if not is_small(first):  # the chunks were shuffled: once is enough
        met = _stored(met, "line-chunks-met")
    columns = ["doc_id", "_row", "begin", "end", "h1", "h2", "ord", "gone"]
    coarse = met.where("first is not null").select(F.lit(True).alias("coarse"), *columns)

    pair = lambda h, q: F.struct(F.get("at", q).alias("begin"), F.get("at", q + 1).alias("end"), h.alias("h1"))
    pairs = F.transform("pairs", pair)
    pairs = F.when(F.col("gone"), F.slice(pairs, F.col("inner") + 1, F.size("pairs") - F.col("inner"))).otherwise(pairs)
    long = F.transform("long", lambda x: F.struct(x["i"].alias("begin"), x["i"].alias("end"), x["h"].alias("h1")))
    fine = met.select("doc_id", "_row", F.explode(F.when(F.col("gone"), pairs).otherwise(F.concat(pairs, long))).alias("p"))
    fine = fine.select("doc_id", "_row", "p.*").withColumn("ord", _order("begin"))
    fine = _near(fine, _repeated(fine, ["h1"]), F.col("h1") == F.col("r_h1"), "inner")
    fine = fine.withColumns({"gone": F.col("ord") != F.col("first"), "h2": F.lit(0), "coarse": F.lit(False)})
    return coarse.unionByName(fine.select("coarse", *columns))


def remove_repeated_chunks(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """``docs`` (doc_id, text) without the lines of runs that stand before, and n_removed (lines) and removed_chars."""
    given, rest = docs, [x for x in docs.columns if x not in ("doc_id", "text", "n_removed", "removed_chars")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    key, row = ["coarse", "h1", "h2"], ["doc_id", "_row"]
    piece = F.struct("begin", "end", *key, "ord", "gone")
    met = repeated_runs(docs, c).groupBy(*row).agg(F.collect_set(piece).alias("pieces"))
    met = settle(met.select(F.col("doc_id").alias("d"), F.col("_row").alias("r"), "pieces"))
    ids = settle(met.select(F.col("r").alias("i")).distinct())
    small = is_small(ids)
    here = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_row") == F.col("r"))
    some = docs.join(F.broadcast(ids), F.col("_row") == F.col("i"), "left_semi") if small else docs
    some = settle(some.join(met, here, "left").drop("d", "r"))

    # Byte by byte: of the runs whose hash repeats, those that share it with another text.
    text_of = lambda lines: F.transform("pieces", lambda p: F.struct(p.alias("p"), F.array_join(F.slice(lines, p["begin"] + 1, p["end"] - p["begin"] + 1), "\n").alias("text")))
    texts = some.where("pieces is not null").select(*row, F.explode(bound(F.split("text", "\n", -1), text_of)).alias("x"))
    texts = texts.select(*row, "x.p.*", "x.text")
    unsure = settle(texts.groupBy(*key, "text").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    if unsure.where("coarse").take(1):  # what such a chunk holds was left out of the second level
        return remove_repeated_chunks(given, replace(c, divisor=1))
    gone = F.filter("pieces", lambda p: p["gone"])
    if unsure.take(1):  # these go if an equal text stands before
        doubtful = texts.join(unsure, key)
        first = doubtful.groupBy(*key, "text").agg(F.min("ord").alias("least"))
        judged = doubtful.join(first, [*key, "text"]).groupBy(F.col("doc_id").alias("d"), F.col("_row").alias("r"))
        judged = judged.agg(F.collect_set(F.struct("begin", "end")).alias("all"), F.collect_set(F.when(F.col("ord") != F.col("least"), F.struct("begin", "end"))).alias("sure"))
        some = some.join(judged, here, "left")
        of = lambda p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"))
        gone = F.filter("pieces", lambda p: F.when(F.coalesce(F.array_contains("all", of(p)), F.lit(False)), F.array_contains("sure", of(p))).otherwise(p["gone"]))
    lost = F.array_distinct(F.flatten(F.transform(gone, lambda p: F.sequence(p["begin"], p["end"]))))
    keep = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost")), lambda i: F.get(lines, i))
    some = some.withColumn("lost", lost).withColumn("left", F.when(F.size("lost") > 0, F.array_join(bound(F.split("text", "\n", -1), keep), "\n")).otherwise(F.col("text")))
    removed = [F.when(F.col("lost").isNotNull(), F.size("lost")).otherwise(0).cast("long").alias("n_removed"), F.coalesce(F.length("text") - F.length("left"), F.lit(0)).cast("long").alias("removed_chars")]
    columns = ["doc_id", F.col("left").alias("text"), *(F.col("_rest")[x].alias(x) for x in rest)]
    out = some.select(*columns, *removed)
    if small:
        same = docs.join(F.broadcast(ids), F.col("_row") == F.col("i"), "left_anti").withColumn("left", F.col("text"))
        out = out.unionByName(same.select(*columns, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("removed_chars")))
    return out
