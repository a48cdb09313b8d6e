"""Folds over arrays that stay in the JVM and grow in proportion to the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items folded together. A fold copies what it has gathered at every step, so it
#: gathers over blocks of this size and over blocks of blocks.
BLOCK = 64


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(xs: Column, size: int) -> Column:
    """The items of a non-empty array in blocks of ``size``."""
    last = F.floor((F.size(xs) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * size + 1, size))


def scan(items: Column, state: Column, emitted: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A running fold: ``step(state, item)`` gives the next state and what is emitted for
    the item. ``state`` is the first state, ``emitted`` the type of what is emitted,
    which should be small (a number or a few). Returns the array of all that is emitted,
    null for null, empty for empty."""
    none = F.array().cast(f"array<{emitted}>")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["st"], x)
        return F.struct(after.alias("st"), F.concat(acc["out"], F.array(out)).alias("out"))

    def nested(inner: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        def fold(acc: Column, part: Column) -> Column:
            zero = F.struct(acc["st"].alias("st"), none.alias("out"))
            return F.aggregate(part, zero, inner, lambda a: F.struct(a["st"].alias("st"), F.concat(acc["out"], a["out"]).alias("out")))

        return fold

    def whole(xs: Column) -> Column:
        cut = F.transform(blocks(xs, BLOCK * BLOCK), lambda ys: blocks(ys, BLOCK))
        folded = F.aggregate(cut, F.struct(state.alias("st"), none.alias("out")), nested(nested(one)))["out"]
        return F.when(F.size(xs) > 0, folded).when(xs.isNotNull(), none)

    return bind(items, whole)
