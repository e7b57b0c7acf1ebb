"""Exact linear-interpolated percentiles that stay distributed.

Each wanted rank is enclosed by two values taken from ``percentile_approx``
(whose rank error is bounded), and only what lies strictly between them is
kept, a few ten-thousandths of the rows, until few enough rows are left to be
counted value by value.  All ranks of all columns are narrowed together, so
the number of passes does not depend on how many there are.

The order is -infinity, numbers, infinity, NaN; nulls are left out.  A rank
that falls on one of the special values is known from their counts alone.
Between two neighbouring ranks the result is interpolated; where both are
equal it is that value, and otherwise an infinite or undefined neighbour
with any weight makes it infinite or undefined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor, inf, nan

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tidewatch.session import stage

FINISH_ROWS = 1_000_000  # rows per interval that are counted value by value
_ACCURACY = 10_000
BINS, BIN_ROUNDS = 1024, 3  # describe counts by that many parts of a stretch, and so often
QUARTERS = (0.25, 0.5, 0.75)


def keyed_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (key, value) of the given numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull())


@dataclass
class _Rank:
    """A wanted rank among the values of ``key`` strictly between ``low`` and ``high``."""
    key: str
    k: int
    n: int
    low: float = -inf
    high: float = inf
    answer: float | None = None

    def shrink(self, low: float, high: float, below: int, at_low: int, between: int, above: int) -> None:
        """Move on to the part that holds the rank, given how many values lie where of ``low`` and ``high``."""
        if self.k < below:
            self.high, self.n = low, below
        elif self.k >= self.n - above:
            self.low, self.k, self.n = high, self.k - (self.n - above), above
        elif self.k < below + at_low:
            self.answer = low
        elif self.k >= below + at_low + between:
            self.answer = high
        else:
            self.low, self.high, self.k, self.n = low, high, self.k - below - at_low, between


def _inside(values: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """Values joined to a small driver table of open intervals (key, low, high, ...)."""
    table = values.sparkSession.createDataFrame(rows, f"key string, low double, high double, {columns}")
    value = F.col("value")
    # one table row per wanted number
    return values.join(F.broadcast(table), "key").filter(
        (value > F.col("low")) & (value < F.col("high")))


def _narrow(values: DataFrame, ranks: dict[int, _Rank], margin: float) -> None:
    """One round for all given ranks: enclose, count, and shrink the intervals."""
    bounds = {i: (max(0.0, (r.k + 0.5) / r.n - margin), min(1.0, (r.k + 0.5) / r.n + margin))
              for i, r in ranks.items()}
    shares = sorted({share for pair in bounds.values() for share in pair})
    # ranks of one column start from the same interval and share its sketch
    spans = {span: i for i, span in enumerate({(r.key, r.low, r.high): 0 for r in ranks.values()})}
    sketches = _inside(values, [(*span, i) for span, i in spans.items()], "span int").groupBy("span").agg(
        F.percentile_approx("value", shares, _ACCURACY).alias("b"))
    near = {row["span"]: dict(zip(shares, row["b"])) for row in sketches.collect()}
    edges = []
    for i, r in ranks.items():
        low, high = (near[spans[(r.key, r.low, r.high)]][share] for share in bounds[i])
        edges.append((r.key, r.low, r.high, i, float(low), float(high)))
    value, low, high = F.col("value"), F.col("from"), F.col("to")
    counted = _inside(values, edges, "rank int, from double, to double").groupBy("rank", "from", "to").agg(
        F.count_if(value < low).alias("below"), F.count_if(value == low).alias("at_low"),
        F.count_if((value > low) & (value < high)).alias("between"),
        F.count_if(value > high).alias("above"))
    for row in counted.collect():
        ranks[row["rank"]].shrink(*(row[name] for name in ("from", "to", "below", "at_low", "between", "above")))


def _resolve(values: DataFrame, wanted: list[_Rank], finish_rows: int) -> None:
    """Fill in every answer."""
    ranks = dict(enumerate(wanted))
    while large := {i: r for i, r in ranks.items() if r.answer is None and r.n > finish_rows}:
        _narrow(values, large, 2.0 / _ACCURACY)
    small = {i: r for i, r in ranks.items() if r.answer is None}
    if not small:
        return
    # at most finish_rows values per interval are left, and equal ones collapse first
    spans = {span: i for i, span in enumerate({(r.key, r.low, r.high): 0 for r in small.values()})}
    counts = _inside(values, [(*span, i) for span, i in spans.items()], "span int").groupBy("span", "value").agg(
        F.count("*").alias("n"))
    seen = F.sum("n").over(Window.partitionBy("span").orderBy("value"))
    places = values.sparkSession.createDataFrame(
        [(spans[r.key, r.low, r.high], i, r.k) for i, r in small.items()], "span int, rank int, k long")
    found = counts.withColumn("seen", seen).join(F.broadcast(places), "span").filter(
        (F.col("seen") > F.col("k")) & (F.col("seen") - F.col("n") <= F.col("k")))
    for row in found.select("rank", "value").collect():  # one row per rank
        ranks[row["rank"]].answer = row["value"]


def _sizes(values: DataFrame, *more: Column) -> list[Row]:
    """A row per key: numbers of values, of infinities and of NaN, and what else is asked for."""
    value = F.col("value")
    return values.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if(value == -inf).alias("below"), F.count_if(value == inf).alias("above"),
        F.count_if(F.isnan(value)).alias("nan"), *more).collect()


def _ranks(values: DataFrame, sizes: list[Row], wanted: dict[str, list[int]] | None, shares: Sequence[float],
           finish_rows: int) -> dict[str, tuple[int, dict[int, float]]]:
    """Per key: number of values, and the value at every wanted rank (or at those beside every share)."""
    value = F.col("value")
    out, open_ranks = {}, []
    for row in sizes:
        n, below = row["n"], row["below"]
        finite = n - below - row["above"] - row["nan"]
        places = wanted[row["key"]] if wanted else sorted(
            {place for q in shares for place in (floor(q * (n - 1)), ceil(q * (n - 1)))})
        answers: dict[int, float | _Rank] = {}
        for k in places:
            if k < below:
                answers[k] = -inf
            elif k < below + finite:
                answers[k] = _Rank(row["key"], k - below, finite)
                open_ranks.append(answers[k])
            else:
                answers[k] = inf if k < below + finite + row["above"] else nan
        out[row["key"]] = (n, answers)
    _resolve(values.filter((value > -inf) & (value < inf)), open_ranks, finish_rows)
    return {key: (n, {k: a.answer if isinstance(a, _Rank) else a for k, a in answers.items()})
            for key, (n, answers) in out.items()}


def kth_smallest(df: DataFrame, column: str, k: int, finish_rows: int = FINISH_ROWS) -> float:
    """k-th smallest (0-based) value of a column; nulls are left out."""
    values = keyed_values(df, [column])
    found = _ranks(values, _sizes(values), {column: [k]}, (), finish_rows)
    return found[column][1][k]


def _between(low: float, high: float, weight: float) -> float:
    if low == high or weight == 0.0:
        return low
    return (1 - weight) * low + weight * high


def _percentiles(values: DataFrame, sizes: list[Row], wanted: Sequence[float],
                 finish_rows: int) -> dict[str, list[float]]:
    """Per key: its percentiles in the order wanted."""
    out = {}
    for key, (n, answers) in _ranks(values, sizes, None, wanted, finish_rows).items():
        places = [q * (n - 1) for q in wanted]
        out[key] = [_between(answers[floor(p)], answers[ceil(p)], p - floor(p)) for p in places]
    return out


def exact_percentiles(values: DataFrame, wanted: Sequence[float], finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(key, q, value) for every key and every wanted fraction.

    ``values`` has columns ``key`` and ``value``; the keys are names of
    columns, so few.
    """
    found = _percentiles(values, _sizes(values), wanted, finish_rows)
    rows = [(key, float(q), value) for key, at in found.items() for q, value in zip(wanted, at)]
    return values.sparkSession.createDataFrame(rows, "key string, q double, value double")


def exact_percentile(df: DataFrame, column: str, q: float, finish_rows: int = FINISH_ROWS) -> float:
    """One percentile of one column, as a number on the driver."""
    rows = exact_percentiles(keyed_values(df, [column]), [q], finish_rows).collect()
    return rows[0]["value"] if rows else None


def _quarter_ranks(told: Row) -> dict[int, float | _Rank]:
    """What is known of the ranks beside the quarters of a column: a special value, or a rank among its numbers."""
    n, below, undefined = told["n"], told["below"], told["nan"]
    finite = n - below - told["above"] - undefined
    out: dict[int, float | _Rank] = {}
    for q in QUARTERS:
        for k in (floor(q * (n - 1)), ceil(q * (n - 1))):
            special = -inf if k < below else inf if k < n - undefined else nan
            out[k] = _Rank(str(told["place"]), k - below, finite) if below <= k < below + finite else special
    return out


Span = tuple[int, float, float]  # a column, and the ends of a stretch of its numbers


def _stretches(wide: DataFrame, spans: Sequence[Span], *more: Sequence[float]) -> DataFrame:
    """A row per number of a column and stretch: ``span``, ``value``, its ends, and what else is told of the stretch.

    Ends and the like travel with the value, so that the code does not grow with the number of columns.
    """
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(at).alias("span"), F.lit(str(i)).alias("key"), F.col(f"v{i}").alias("value"),
                 F.lit(low).alias("low"), F.lit(high).alias("high"), *[F.lit(x[at]).alias(f"more{n}") for n, x in enumerate(more)])
        for at, (i, low, high) in enumerate(spans)])))


def _bins(wide: DataFrame, spans: Sequence[Span]) -> dict[Span, list[Row]]:
    """Per stretch its bins with values, in order: their number, the least and the largest; at most ``BINS``."""
    scales = [BINS / (high - low) if high > low else 0.0 for _, low, high in spans]
    value, low = F.col("value"), F.col("low")
    inside = _stretches(wide, spans, scales).filter((value >= low) & (value <= F.col("high")))
    place = F.least(F.floor((value - low) * F.col("more0")), F.lit(BINS - 1))  # rises with the value
    counted = inside.groupBy("span", place.alias("bin")).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
    out: dict[Span, list[Row]] = {span: [] for span in spans}
    for row in sorted(counted, key=lambda row: (row["span"], row["bin"])):
        out[spans[row["span"]]].append(row)
    return out


def _into_bin(rank: _Rank, bins: list[Row]) -> Span:
    """Shrink a rank to the bin that holds it, given those of its stretch, and return that bin's own stretch."""
    seen = 0
    for at, row in enumerate(bins):
        if rank.k < seen + row["n"]:
            break
        seen += row["n"]
    if row["low"] == row["high"]:
        rank.answer = row["low"]
    rank.low = bins[at - 1]["high"] if at else rank.low
    rank.high = bins[at + 1]["low"] if at + 1 < len(bins) else rank.high
    rank.k, rank.n = rank.k - seen, row["n"]
    return int(rank.key), row["low"], row["high"]


def describe(df: DataFrame, columns: Sequence[str], finish_rows: int = FINISH_ROWS) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max per column, one row each.

    A column of nulls only gives no row.  All columns go through the same few
    aggregates, a value a row: the first tells counts, moments and ends, the
    next ones count the numbers by ``BINS`` equal parts of the stretches that
    hold a quartile.  Only values in stretches of few rows are looked at one
    by one.
    """
    places = range(len(columns))
    wide = stage(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), "described")
    value = F.col("value")
    number = F.when((value > -inf) & (value < inf), value)
    cells = wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"v{i}").alias("value")) for i in places])))
    told = {row["place"]: row for row in cells.groupBy("place").agg(
        F.count(value).alias("n"), F.count_if(value == -inf).alias("below"), F.count_if(value == inf).alias("above"),
        F.count_if(F.isnan(value)).alias("nan"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.min(number).alias("low"), F.max(number).alias("high")
    ).collect() if row["n"]}  # a row per column
    answers = {i: _quarter_ranks(told[i]) for i in sorted(told)}
    ranks = [(a, (i, told[i]["low"], told[i]["high"])) for i, known in answers.items() for a in known.values()
             if isinstance(a, _Rank)]
    for turn in range(BIN_ROUNDS):  # what is large after them is narrowed by sketches
        large = {span for r, span in ranks if r.answer is None and r.n > (finish_rows if turn else 0)}
        if not large:
            break
        bins = _bins(wide, sorted(large))
        ranks = [(r, _into_bin(r, bins[span]) if r.answer is None and span in bins else span) for r, span in ranks]
    left = [r for r, _ in ranks if r.answer is None]
    if left:
        near = _stretches(wide, sorted({(int(r.key), r.low, r.high) for r in left}))
        _resolve(near.filter((value > F.col("low")) & (value < F.col("high"))).select("key", "value"), left, finish_rows)
    rows = []
    for i, known in answers.items():
        at = {k: a.answer if isinstance(a, _Rank) else a for k, a in known.items()}
        wanted = [q * (told[i]["n"] - 1) for q in QUARTERS]
        quarters = [_between(at[floor(p)], at[ceil(p)], p - floor(p)) for p in wanted]
        rows.append((columns[i], *(told[i][name] for name in ("n", "mean", "std", "min")), *quarters, told[i]["max"]))
    return df.sparkSession.createDataFrame(
        rows, "feature string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
