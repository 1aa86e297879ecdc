"""SQL-side helpers on spans of text, in code points, without any Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are numbered together; appending to an array copies it, so arrays are built in blocks.
BLOCK = 256
#: Code points of a piece of text; finding a place in a string walks it from its start.
PIECE = 1000
SPAN = "array<struct<s:int,e:int,v:string,left:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, of: Callable[[Column], Column]) -> Column:
    """For each item the sum of of(item) over the items before it; linear but for one append a block."""

    def starts(values: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc)

    def whole(values: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(BLOCK))
        return let(F.transform(cuts, lambda i: starts(F.slice(values, i + 1, F.lit(BLOCK)))), placed)

    def placed(blocks: Column) -> Column:
        bases = starts(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["out"], lambda x: x + base)))

    return let(F.transform(items, of), whole)


def found(text: Column, pattern: str, when: Column | None = None, left: int = 0) -> Column:
    """Non-overlapping matches of a Java pattern as an array of (s, e, v, left): start, exclusive end, matched
    text, and up to left code points of the text between the match before and it.

    The pattern must have no group that matters.  The text between the matches is had by splitting,
    so that starts follow from lengths in code points."""
    made = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    before = lambda g: F.substring(g, -left, left) if left else F.lit(None).cast("string")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), before(g).alias("left")))
    zipped = F.zip_with(gaps, made, lambda g, m: F.struct(g["n"].alias("n"), g["left"].alias("left"), m.alias("m")))

    def spans(items: Column) -> Column:
        at = running(items, lambda x: x["n"] + F.length(x["m"]))
        item = lambda x, a: F.struct((a + x["n"]).cast("int").alias("s"), (a + x["n"] + F.length(x["m"])).cast("int").alias("e"), x["m"].alias("v"), x["left"].alias("left"))
        return F.zip_with(items, at, item)

    got = let(F.filter(zipped, lambda x: x["m"].isNotNull()), spans)
    none = F.array().cast(SPAN)
    return F.coalesce(F.when(F.coalesce(when if when is not None else F.lit(True), F.lit(False)) & text.rlike(pattern), got), none)


def pieces(text: Column) -> Column:
    """A text cut into pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, a: Column, b: Column) -> Column:
    """The text from code point a up to b of a text that was cut into pieces, without a walk from its start."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    one = lambda k: F.coalesce(F.get(cut, k), F.lit(""))
    head = F.substring(one(i), a - i * PIECE + 1, F.lit(PIECE))
    middle = F.array_join(F.slice(cut, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    return F.when(b <= a, "").when(i == j, F.substring(one(i), a - i * PIECE + 1, b - a)).otherwise(F.concat(head, middle, F.substring(one(j), F.lit(1), b - j * PIECE)))
