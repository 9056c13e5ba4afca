"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The mark of a missing transcript, and what a finished sentence ends with.
UNAVAILABLE = "TRANSCRIPT_UNAVAILABLE"
BOUNDARY = r"""[.!?]["')\]]?\s*$"""


def trimmed(text: Column | str) -> Column:
    """`text` without white space, of any kind, at its ends."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def by_track(*order: Column | str):
    """The window of one recording, in the given order."""
    w = W.partitionBy("track_id")
    return w.orderBy(*order) if order else w


def half_up(x: Column) -> Column:
    """Rounds halves up, towards positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def ends_sentence(text: Column) -> Column:
    return F.coalesce(trimmed(text), F.lit("")).rlike(BOUNDARY)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(high, F.greatest(low, x))


def unfenced(raw: Column) -> Column:
    """A model's answer less the lines of a code fence around it; if that doesn't start with a brace, what stands
    between its outermost braces, where it has them."""
    lines = F.split(trimmed(raw), "\n")
    mark = F.lit("```")
    opened = F.get(lines, F.lit(0)).startswith(mark) & (F.size(lines) > 1)
    closed = opened & (F.get(lines, F.size(lines) - 1) == mark)
    inner = F.slice(lines, F.when(opened, 2).otherwise(1), F.size(lines) - opened.cast("int") - closed.cast("int"))
    text = trimmed(F.array_join(inner, "\n"))
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braced = (first > 1) & (last > first) & text.contains("}")
    return F.when(braced, F.substr(text, first, last - first + 1)).otherwise(text)


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A field of a variant, null where it's missing or can't be read as `kind`."""
    return F.try_variant_get(v, path, kind)
