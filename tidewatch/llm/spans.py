"""Positions of pattern matches in texts, with built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

CONTEXT_CHARS = 64
PIECE = 512
_INTS = "array<int>"


def _running(sizes: Column) -> Column:
    """Running sums of an array of numbers.

    A fold copies what it has gathered at every step, so it gathers numbers
    only, and a piece of them at a time: some ``PIECE`` copies of a number
    instead of as many as there are numbers.
    """
    empty = F.array().cast(_INTS)

    def last(sums: Column, base: Column) -> Column:
        return F.coalesce(F.try_element_at(sums, F.lit(-1)), base)

    def summed(piece: Column, base: Column) -> Column:
        return F.aggregate(piece, empty, lambda sums, size: F.concat(sums, F.array(last(sums, base) + size)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PIECE).cast("int")),
                         lambda i: F.slice(sizes, i * PIECE + 1, F.lit(PIECE)))
    start = F.struct(F.lit(0).alias("base"), F.array().cast("array<array<int>>").alias("parts"))

    def step(state: Column, piece: Column) -> Column:
        total = F.aggregate(piece, state["base"], lambda so_far, size: so_far + size)
        return F.struct(total.alias("base"),
                        F.concat(state["parts"], F.array(summed(piece, state["base"]))).alias("parts"))

    sums = F.flatten(F.aggregate(pieces, start, step, lambda state: state["parts"]))
    return F.when(F.size(sizes) > 0, sums).otherwise(empty)


def with_spans(rows: DataFrame, patterns: Mapping[str, tuple[str, Column]], context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Add a column per pattern: all leftmost non-overlapping matches of it in ``text``, where its condition holds.

    A match is ``{at, upto, match, left}``.  Positions are code points from 0,
    the end exclusive; ``left`` is the text before the match, earlier matches
    included, at most ``context_chars`` long, so a longer context is cut in
    its first word.  Splitting at the pattern gives what lies between the
    matches, and running lengths give the positions.  Every helper is a
    column, so that it is computed once; work is linear in the text.
    """
    none = F.array().cast("array<string>")
    text = F.col("text")
    for name, (pattern, where) in patterns.items():
        rows = rows.withColumn(name, F.when(where, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for name, (pattern, _) in patterns.items():
        rows = rows.withColumn(f"_gaps_{name}", F.when(
            F.size(name) > 0, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(name))).otherwise(none))
    rows = rows.withColumns({f"_sizes_{name}": F.zip_with(
        f"_gaps_{name}", name, lambda gap, match: F.length(gap) + F.length(match)) for name in patterns})
    rows = rows.withColumns({
        **{f"_ends_{name}": _running(F.col(f"_sizes_{name}")) for name in patterns},
        # the end of each gap with its match; as many of them as there are characters always hold the whole context
        **{f"_tails_{name}": F.zip_with(f"_gaps_{name}", name, lambda gap, match: F.right(
            F.concat(F.right(gap, F.lit(context_chars)), F.right(match, F.lit(context_chars))), F.lit(context_chars)))
           for name in patterns}})
    rows = rows.withColumns({name: _placed(name, context_chars) for name in patterns})
    return rows.drop(*[f"_{part}_{name}" for name in patterns for part in ("gaps", "sizes", "ends", "tails")])


def _placed(name: str, context_chars: int) -> Column:
    """The matches of a pattern with their places and what stands before them."""
    gaps, tails = F.col(f"_gaps_{name}"), F.col(f"_tails_{name}")

    def before(i: Column) -> Column:
        gap = F.right(F.get(gaps, i), F.lit(context_chars))
        first = F.greatest(i - context_chars, F.lit(0))
        earlier = F.when(F.length(gap) < context_chars, F.array_join(F.slice(tails, first + 1, i - first), ""))
        return F.right(F.concat(F.coalesce(earlier, F.lit("")), gap), F.lit(context_chars))

    def span(pair: Column, i: Column) -> Column:
        return F.struct((pair["end"] - F.length(pair["match"])).alias("at"), pair["end"].alias("upto"),
                        pair["match"].alias("match"), before(i).alias("left"))

    return F.transform(F.arrays_zip(F.col(f"_ends_{name}").alias("end"), F.col(name).alias("match")), span)
