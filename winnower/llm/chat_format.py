"""Chat formatting by a grammar round trip, in DataFrame operations only.

A conversation is rendered as a run of turns::

    turn  := OPENER role AFTER_ROLE text CLOSER

and read back by a deterministic parser: split at CLOSER; each piece must begin with OPENER, its role
ends at the first AFTER_ROLE, and neither role nor text may hold a control string. Texts are read with
``\\\\`` as one backslash and ``\\e`` as nothing.

Rendering starts from the raw texts. A turn that the parser doesn't give back identically is escaped
(backslashes doubled, ``\\e`` put after the first character of every control string). The whole
conversation is parsed again and compared with its source; one that still differs gets all its turns
escaped, which is reversible by construction; should even that differ, the job stops with an error.

Defined results: turns are ordered by (turn, role, text), nulls first; a null role or text is an empty
one; rows that repeat stay as turns of their own; a null conv_id is a conversation of its own; other
columns are ignored; an empty table gives no rows. A conversation becomes one row, so it has to fit
into a row (2 GB), whichever way it is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BACKSLASH = "\\"


@dataclass(frozen=True)
class Template:
    opener: str = "### "
    after_role: str = ":\n"
    closer: str = "</turn>\n"
    trained_roles: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return self.opener, self.closer.strip()

    def role_controls(self) -> tuple[str, ...]:
        return *self.controls(), self.after_role


def escape(text: Column, controls: tuple[str, ...]) -> Column:
    out = F.replace(text, F.lit(BACKSLASH), F.lit(BACKSLASH * 2))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + BACKSLASH + "e" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    pieces = F.transform(F.split(text, BACKSLASH * 4, -1), lambda p: F.replace(p, F.lit(BACKSLASH + "e"), F.lit("")))
    return F.array_join(pieces, BACKSLASH)


def _holds(text: Column, controls: tuple[str, ...]) -> Column:
    return F.greatest(*(F.contains(text, F.lit(c)) for c in controls), F.lit(False))


def _render(role: Column, text: Column, t: Template) -> Column:
    return F.concat(F.lit(t.opener), role, F.lit(t.after_role), text, F.lit(t.closer))


def parse(formatted: Column, t: Template = Template()) -> Column:
    """array<struct<role, text>> of a formatted conversation; a piece that breaks the grammar is null."""

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(t.opener) + 1, 2**31 - 1)
        at = F.locate(t.after_role, rest)
        role, text = F.left(rest, at - 1), F.substr(rest, at + len(t.after_role))
        sound = F.startswith(piece, F.lit(t.opener)) & (at > 0) & ~_holds(role, t.controls()) & ~_holds(text, t.controls())
        return F.when(sound, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    pieces = F.split(formatted, rf"\Q{t.closer}\E", -1)
    turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)
    unended = F.transform(F.filter(F.slice(pieces, -1, 1), lambda p: p != ""), lambda p: F.when(p == "", F.struct(p.alias("role"), p.alias("text"))))
    return F.concat(turns, unended)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def format_conversations(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns, escaping) per conversation of ``turns`` (conv_id, turn, role, text).

    ``loss_spans`` has start and length, in code points of ``formatted``, of each text of a trained role.
    ``escaping`` is 0 if no turn was escaped, 1 if those in conflict were, 2 if all were.
    """
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    safe = lambda c, controls: (unescape(F.col(c)) == F.col(c)) & ~_holds(F.col(c), controls)  # noqa: E731  comes back as it is
    pick = lambda c, controls: F.when(F.col(f"safe_{c}"), F.col(c)).otherwise(F.col(f"esc_{c}"))
    parts = clean.withColumns({"safe_role": safe("role", t.role_controls()), "safe_text": safe("text", t.controls()), "esc_role": escape(F.col("role"), t.role_controls()), "esc_text": escape(F.col("text"), t.controls())})
    parts = parts.withColumns({"mixed_role": pick("role", None), "mixed_text": pick("text", None)})
    frame = len(t.opener) + len(t.after_role) + len(t.closer)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    for kind in ("mixed", "esc"):
        text = F.length(f"{kind}_text")
        parts = parts.withColumn(f"{kind}_end", F.sum(frame + F.length(f"{kind}_role") + text).over(order))
        parts = parts.withColumn(f"{kind}_span", F.struct((F.col(f"{kind}_end") - len(t.closer) - text).cast("int").alias("start"), text.alias("length")))
        parts = parts.withColumn(f"{kind}_turn", _render(F.col(f"{kind}_role"), F.col(f"{kind}_text"), t))
    row = F.struct("turn", "role", "text", "mixed_end", "mixed_turn", "esc_turn", "mixed_span", "esc_span", (~F.col("safe_role") | ~F.col("safe_text")).alias("changed"))
    rows = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def spans(kind: str) -> Column:
        trained = F.filter("rows", lambda r: r["role"].isin(*t.trained_roles))
        return F.transform(trained, lambda r: r[f"{kind}_span"])

    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    made = rows.withColumns({"source": source, "mixed": F.array_join(F.col("rows.mixed_turn"), ""), "all": F.array_join(F.col("rows.esc_turn"), "")})
    made = made.withColumn("same", parse(F.col("mixed"), t) == F.col("source"))
    made = made.withColumn("formatted", F.when(F.col("same"), F.col("mixed")).otherwise(F.col("all")))
    broken = ~F.coalesce(F.col("same") | (parse(F.col("all"), t) == F.col("source")), F.lit(False))
    return made.select(
        "conv_id",
        F.when(broken, F.raise_error(F.lit("a conversation didn't survive its round trip"))).otherwise(F.col("formatted")).alias("formatted"),
        F.when(F.col("same"), spans("mixed")).otherwise(spans("esc")).alias("loss_spans"),
        F.size("rows").cast("long").alias("n_turns"),
        F.when(~F.col("same"), 2).when(F.exists("rows", lambda r: r["changed"]), 1).otherwise(0).alias("escaping"),
    )
