"""Delta and variable-byte coding of ascending integers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delta_encode(values: Column) -> Column:
    """First value, then differences."""
    before = F.concat(F.array(F.lit(0)), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))))
    return F.when(F.size(values) > 0, F.zip_with(values, before, lambda a, b: a - b)).otherwise(values)


def delta_decode(rows: DataFrame, keys: list[str], deltas: str) -> DataFrame:
    """(keys, k, value): running sums of each row's differences, one row for each value. keys tell the rows apart."""
    each = rows.select(*keys, F.posexplode(deltas).alias("k", "_delta"))
    running = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*keys, "k", F.sum("_delta").over(running).alias("value"))


def varbyte(values: Column) -> Column:
    """The bytes of a list of values, one after another."""
    return F.unhex(F.array_join(F.transform(values, varbyte_hex), ""))


def varbyte_length(value: Column) -> Column:
    """Bytes that a value takes: seven bits each, low bits first."""
    v = value.cast("bigint")
    sized = F.lit(1)
    for k in range(1, 9):
        sized = sized + (v >= F.lit(1 << (7 * k)).cast("bigint")).cast("int")
    return F.when(v < 0, F.raise_error(F.lit("negative value"))).otherwise(sized)


def varbyte_hex(value: Column) -> Column:
    """Hex of a value's bytes; all but the last have the high bit set."""
    v = value.cast("bigint")
    parts = [F.when(v >= F.lit(1 << (7 * k)).cast("bigint") if k else F.lit(True), F.lpad(F.hex(
        F.shiftright(v, 7 * k).bitwiseAND(F.lit(127)) + F.when(F.shiftright(v, 7 * k) >= 128, 128).otherwise(0)), 2, "0")) for k in range(9)]
    return F.when(v < 0, F.raise_error(F.lit("negative value"))).otherwise(F.concat_ws("", *parts))
