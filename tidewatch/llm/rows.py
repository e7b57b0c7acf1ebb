"""Rows of a table with a number of their own, so that single rows can be dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import stage


def numbered(docs: DataFrame) -> DataFrame:
    """``doc``, a struct of all columns, and ``row``, a number; staged, so that the numbers stay.

    The struct keeps columns of any name apart from those of an operator;
    readers of single fields read only these from the stored table.
    """
    whole = F.struct(*[docs[name] for name in docs.columns])
    return stage(docs.select(whole.alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")


def without(rows: DataFrame, losers: DataFrame) -> DataFrame:
    """The original columns of the rows whose ``row`` is not among the ``losers``.

    These are the smaller side, stored so that their size is known; where they
    fit a broadcast, no text is shuffled.
    """
    return rows.join(stage(losers.select("row"), "losers"), "row", "left_anti").select("doc.*")
