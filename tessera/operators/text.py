"""Texts as lines: heads, tails, edits, chunks and clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def head_lines(text: Column, n: int) -> Column:
    """The first n lines; 0 is the whole text, a negative n leaves out the last lines."""
    if n == 0:
        return text
    ls = lines(text)
    return F.array_join(F.slice(ls, F.lit(1), F.lit(n) if n > 0 else F.greatest(F.size(ls) + n, F.lit(0))), "\n")


def tail_lines(text: Column, n: int) -> Column:
    """The last n lines; 0, or more than there are, is the whole text."""
    if n == 0:
        return text
    return F.array_join(F.reverse(F.slice(F.reverse(lines(text)), 1, n)), "\n")


def edited(text: Column, edits: Sequence[tuple[str, str]]) -> Column:
    """Each line with the literal replacements made in turn, each on what the one before left."""

    def one(line: Column) -> Column:
        for old, new in edits:
            line = F.replace(line, F.lit(old), F.lit(new))
        return line

    return F.array_join(F.transform(lines(text), one), "\n")


def edit_log(df: DataFrame, edits: Sequence[tuple[str, str]], key: str, text_col: str = "text") -> DataFrame:
    """(key, edit, line, before, after): the lines that each edit, in turn, changes; line numbers from 1. The lines are
    taken apart once; all edits are folded over each of them."""
    steps = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(old).alias("old"), F.lit(new).alias("new")) for i, (old, new) in enumerate(edits, 1)])
    nothing = F.array().cast("array<struct<edit: int, before: string, after: string>>")

    def fold(so_far, e):
        now = so_far["now"]
        after = F.replace(now, e["old"], e["new"])
        entry = F.array(F.struct(e["n"].alias("edit"), now.alias("before"), after.alias("after")))
        return F.struct(after.alias("now"), F.when(F.contains(now, e["old"]), F.concat(so_far["log"], entry)).otherwise(so_far["log"]).alias("log"))

    log = F.aggregate(steps, F.struct(F.col("line").alias("now"), nothing.alias("log")), fold, lambda x: x["log"])
    each = df.select(key, F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
    return each.select(key, (F.col("pos") + 1).alias("line"), F.explode(log).alias("e")).select(key, "e.edit", "line", "e.before", "e.after")


def without_reasoning(text: Column) -> Column:
    """Text without what stands between <think> and </think>."""
    return F.regexp_replace(text, "(?s)<think>.*?</think>", "")


def word_chunks(df: DataFrame, key: str, text_col: str = "text", size: int = 200, context: int = 50) -> DataFrame:
    """(key, chunk, n_words, body): chunks of so many words, each but the first with context words of the one before."""
    words = df.select(key, F.split(text_col, " ", -1).alias("w"))
    n = words.select(key, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).alias("chunk"))
    first = F.greatest(F.lit(1), F.col("chunk") * size + 1 - context)
    part = F.slice("w", first, (F.col("chunk") + 1) * size + 1 - first)
    return n.select(key, "chunk", F.size(part).alias("n_words"), F.array_join(part, " ").alias("body"))


def rail(df: DataFrame, flagged: DataFrame, key: str, flag: str, max_length: int = 10**11, text_col: str = "text") -> DataFrame:
    """Ordered checks of an input or output rail: length first, then a yes/no classifier, given as a table (key, flag).

    Adds blocked and reason. The classifier is pluggable; labels stand in for a language model's verdict.
    """
    j = df.join(flagged.select(key, flag), key, "left")
    reason = F.when(F.length(text_col) > max_length, "length").when(F.coalesce(F.col(flag), F.lit(0)) == 1, "self check")
    return j.withColumn("reason", reason).withColumn("blocked", F.col("reason").isNotNull()).drop(flag)


def rails(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with blocked and reason: the first check, in order, whose condition holds stops the row; a null doesn't."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(checks):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("blocked", F.col("reason").isNotNull())


def any_of(values: Column, condition) -> Column:
    """Whether any element of an array meets the condition; false for empty and null arrays."""
    return F.coalesce(F.exists(values, condition), F.lit(False))


def any_by(df: DataFrame, by: Sequence[str], condition: Column) -> DataFrame:
    """(by, found): whether any row of the group meets the condition; combined before the shuffle."""
    return df.groupBy(*by).agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("found"))
