"""Row-level money expressions over the billing export.

All of them are built-in Column expressions (no Python per row).  Credits are read through ``credits.amount`` first, which turns
``array<struct<...>>`` into ``array<amount>`` so that parquet reads only the
``amount`` leaf of the nested column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schema as S


def credit_amount_type(df: DataFrame) -> T.DataType:
    credits = df.schema[S.CREDITS].dataType
    if not isinstance(credits, T.ArrayType) or not isinstance(credits.elementType, T.StructType):
        raise TypeError(f"'{S.CREDITS}' must be array<struct<amount,...>>, got {credits.simpleString()}")
    return credits.elementType["amount"].dataType


def _accumulator_type(amount_type: T.DataType) -> T.DataType:
    """Type to add up in: wider than the input, with a digit to spare for one more addition."""
    if isinstance(amount_type, T.DecimalType):
        return T.DecimalType(min(37, amount_type.precision + 10), amount_type.scale)
    return T.DoubleType()


def exact_sum(a: Column, b: Column, a_type: T.DataType, b_type: T.DataType) -> Column:
    """``a + b`` with every decimal place kept.

    Adding two DECIMALs of full precision would round the last place away; both
    are first brought to one type that leaves room for the carry.
    """
    if not (isinstance(a_type, T.DecimalType) and isinstance(b_type, T.DecimalType)):
        return a + b
    scale = max(a_type.scale, b_type.scale)
    whole = max(a_type.precision - a_type.scale, b_type.precision - b_type.scale)
    wide = T.DecimalType(min(37, whole + scale), scale)
    return a.cast(wide) + b.cast(wide)


def first_credit_amount(amount_type: T.DataType) -> Column:
    """Amount of the first credit, 0 when there is none, null for a null array.

    ``get`` returns null instead of failing on an out-of-range index (ANSI mode).
    The length is taken from ``credits.amount`` (same length, null for a null
    array) so that only the ``amount`` leaf is read from parquet.
    """
    amounts = F.col(f"{S.CREDITS}.amount")
    zero = F.lit(0).cast(amount_type)
    return F.when(F.size(amounts) == 0, zero).otherwise(F.get(amounts, 0))


def credit_total(amount_type: T.DataType) -> Column:
    """Sum of all credit amounts of a row; 0 for an empty or null array.

    Null amounts are skipped, as SQL ``SUM`` over the unnested array would.
    The fold is a row expression: computed in a projection of its own, it leaves
    the aggregation above it in whole-stage codegen.
    """
    acc_type = _accumulator_type(amount_type)
    zero = F.lit(0).cast(acc_type)
    amounts = F.col(f"{S.CREDITS}.amount")
    total = F.aggregate(amounts, zero, lambda acc, x: (acc + F.coalesce(x.cast(acc_type), zero)).cast(acc_type))
    return F.coalesce(total, zero)


def pct_change(current: Column, previous: Column) -> Column:
    """``(current - previous) / previous * 100``; null when previous is 0 or null."""
    return F.try_divide(current - previous, previous) * F.lit(100.0)


def as_double(c: Column) -> Column:
    return c.cast("double")
