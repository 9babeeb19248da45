"""Ordered folds that stay parallel when one key holds most of the rows.

A plain window over a key puts the whole key into one task. Here the order column, a unique
bigint such as a line number, is cut into blocks of consecutive values; a block can hold no
more rows than it has values. One row per block is folded over the key, and what it finds opens the
window over each (key, block). The blocks' rows are folded in the same way, ``LEVELS`` deep, so
that sparse numbers, which make many blocks, do not gather in one task either. There is no
join, and no key is looked for beforehand: every key is cut alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 200_000
BLOCK = "_block"
# Above the first level a block is so many blocks of the level below it.
FAN_IN = 10_000
LEVELS = 2

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def block_of(order: str, rows: int = BLOCK_ROWS) -> Column:
    return F.expr(f"`{order}` div {int(rows)}L")


def _fold(
    df, by, order, folds, block_rows, last, descending=False, shared=False, levels=LEVELS
) -> DataFrame:
    def sequence(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    def results(window) -> dict[str, Column]:
        found = {}
        for out, (value, kind) in folds.items():
            folded = _FOLDS[kind](f"_in{levels}_{out}").over(window)
            found[out] = F.coalesce(folded, F.lit(0)) if kind == "sum" else folded
        return found

    values = {f"_in{levels}_{out}": value for out, (value, _) in folds.items()}
    if not levels:
        whole = Window.partitionBy(*by).orderBy(sequence(order))
        rows = df.withColumns(values)
        return rows.withColumns(results(whole.rowsBetween(Window.unboundedPreceding, last))).drop(*values)

    block, own = f"{BLOCK}{levels}", f"_own{levels}"
    passed = [c for c in df.columns if c not in {*by, order}] if shared else []
    kinds = {f"_in{levels}_{out}": kind for out, (_, kind) in folds.items()}
    rows = df.withColumns({block: block_of(order, block_rows), **values})
    totals = rows.groupBy(*by, block).agg(
        *[_FOLDS[kind](name).alias(name) for name, kind in kinds.items()],
        *[F.count(c).alias(f"_has_{c}") for c in passed],
    )
    if shared:
        # The counts are not needed, but reading the columns they count is what makes both
        # uses of the input identical; the filter keeps them from being pruned.
        totals = totals.filter(F.greatest(F.lit(0), *[F.col(f"_has_{c}") for c in passed]) >= 0)
    before = {name: (F.col(name), kind) for name, kind in kinds.items()}
    folded = _fold(totals, by, block, before, FAN_IN, -1, descending, levels=levels - 1)
    carried = folded.select(*by, block, *kinds)
    # What earlier blocks add up to comes in as a row ahead of the block's own rows.
    both = rows.withColumn(own, F.lit(1)).unionByName(
        carried.withColumn(own, F.lit(0)), allowMissingColumns=True
    )
    within = Window.partitionBy(*by, block).orderBy(own, sequence(order))
    done = both.withColumns(results(within.rowsBetween(Window.unboundedPreceding, last)))
    return done.filter(F.col(own) == 1).drop(block, own, *values)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    folds: Mapping[str, tuple[Column, str]],
    block_rows: int = BLOCK_ROWS,
    before_only: bool = False,
    shared: bool = False,
) -> DataFrame:
    """Fold from the first row of the key to this one (or the one before it).

    ``folds`` maps an output name to (value, ``sum`` | ``max`` | ``min``). The input is used
    twice. A stored table is cheap to read twice, with few columns the second time; for an
    input that comes out of a shuffle say ``shared``, and Spark runs that shuffle once.
    """
    return _fold(df, by, order, folds, block_rows, -1 if before_only else 0, shared=shared)


def following(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    folds: Mapping[str, tuple[Column, str]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fold over the rows of the key after this one.

    The order is reversed: a frame that ends at the last row would be folded anew for every
    row, one that starts at the first row is folded once.
    """
    return _fold(df, by, order, folds, block_rows, -1, descending=True)
