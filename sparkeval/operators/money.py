"""Amounts of money: decimals of twelve places with a currency, never negative.

Cases: a null amount or currency gives null; an amount below zero (after rounding), beyond the decimal's
range or not finite, a currency that is not of three letters, and sums or differences of unlike currencies
fail the query.  Sums are partial aggregates, and exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 12
AMOUNT = f"decimal(38,{PLACES})"


def _fail(text: str, kind: str) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def money(amount: Column, currency: Column) -> Column:
    """``struct<amount, currency>``: rounded half to even to twelve places, the code trimmed and in upper case.

    Doubles stand for the decimals that they are written as.
    """
    exact = F.bround(amount.cast("string").cast("decimal(38,18)"), PLACES).cast(AMOUNT)
    code = F.upper(F.trim(currency))
    value = F.when(amount.isNull(), None).when(exact.isNull() | (exact < 0), _fail("a money amount is finite and not negative", AMOUNT)).otherwise(exact)
    unit = F.when(code.isNull() | code.rlike(r"^\p{L}{3}$"), code).otherwise(_fail("a currency is a code of three letters", "string"))
    return F.when(amount.isNotNull() & currency.isNotNull(), F.struct(value.alias("amount"), unit.alias("currency")))


def _alike(a: Column, b: Column, out: Column) -> Column:
    return F.when(a["currency"] == b["currency"], out).when(a.isNotNull() & b.isNotNull(), _fail("currencies must match", AMOUNT))


def plus(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(_alike(a, b, (a["amount"] + b["amount"]).cast(AMOUNT)).alias("amount"), a["currency"].alias("currency")))


def minus(a: Column, b: Column) -> Column:
    """The difference; a negative one fails."""
    left = F.when(a["amount"] >= b["amount"], (a["amount"] - b["amount"]).cast(AMOUNT)).otherwise(_fail("a money amount is finite and not negative", AMOUNT))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(_alike(a, b, left).alias("amount"), a["currency"].alias("currency")))


def total(rows: DataFrame, keys: list[str], money_col: str, out_col: str = "total") -> DataFrame:
    """Per key: the sum of the amounts, which must be of one currency; a key without amounts gives null."""
    m = F.col(money_col)
    low, high, amount = F.min(m["currency"]), F.max(m["currency"]), F.sum(m["amount"])
    made = rows.groupBy(*keys).agg(low.alias("__low"), high.alias("__high"), amount.alias("__sum"), F.count(m).alias("__n"))
    checked = F.when(F.col("__low") != F.col("__high"), _fail("currencies must match", AMOUNT)).when(
        F.col("__sum").isNull(), _fail("a sum of money is beyond its decimals", AMOUNT)
    ).otherwise(F.col("__sum").cast(AMOUNT))
    return made.select(*keys, F.when(F.col("__n") > 0, F.struct(checked.alias("amount"), F.col("__low").alias("currency"))).alias(out_col))
