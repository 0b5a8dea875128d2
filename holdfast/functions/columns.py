"""Column-level building blocks.

Everything here is a Column expression over built-in functions, so it stays
inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from holdfast.schemas import MONEY

GRANULARITIES = {"day": None, "daily": None, "week": "week", "weekly": "week",
                 "month": "month", "monthly": "month", "year": "year", "yearly": "year"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signed_quantity(trade_type: str | Column = "trade_type", quantity: str | Column = "quantity") -> Column:
    """Buys count positive; anything else (sells, null, other case) negative."""
    q = _col(quantity)
    return F.when(_col(trade_type) == F.lit("buy"), q).otherwise(-q)


def weighted_average(price: str | Column, quantity: str | Column) -> Column:
    """sum(price * quantity) / sum(quantity) with an exact decimal numerator.

    The numerator is summed as a decimal so the result does not depend on the
    order rows arrive in; a zero divisor (a day whose buys and sells cancel)
    gives null instead of an error.
    """
    numerator = F.sum(_col(price).cast(MONEY) * _col(quantity).cast("decimal(18,0)"))
    return F.try_divide(numerator.cast("double"), F.sum(_col(quantity)).cast("double"))


def exact_sum(c: str | Column, scale: int = 2) -> Column:
    """Order-independent sum of money values (decimal inside, double out)."""
    return F.sum(_col(c).cast(f"decimal(20,{scale})")).cast("double")


def truncate_date(granularity: str | None, c: str | Column = "timestamp") -> Column:
    """Start of the week (Monday), month or year of a date; the date itself for daily."""
    unit = GRANULARITIES.get((granularity or "day").lower(), "invalid")
    if unit == "invalid":
        raise ValueError(f"unknown granularity {granularity!r}; use one of {sorted(GRANULARITIES)}")
    if unit is None:
        return _col(c).cast("date")
    return F.date_trunc(unit, _col(c)).cast("date")


def slug(c: str | Column) -> Column:
    """Every character outside [a-zA-Z0-9] becomes '_', then lower case."""
    return F.lower(F.regexp_replace(_col(c), "[^a-zA-Z0-9]", "_"))


def map_lookup(mapping: Mapping[str, str], c: str | Column, default: str | None = None) -> Column:
    """Dictionary lookup as a map literal; unknown keys give ``default``."""
    pairs = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    looked_up = F.try_element_at(F.create_map(*pairs), _col(c))
    return looked_up if default is None else F.coalesce(looked_up, F.lit(default))


def falsy_to_null(value: Column, target: str = "string") -> Column:
    """Python truthiness of a JSON value held in a VARIANT, as a typed column.

    null, a missing key, "" , false and any numeric zero become null; the
    string "0" stays. ``target`` is the Spark type of the result.
    """
    kind = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    as_number = F.try_variant_get(value, "$", "double")
    numeric = kind.startswith("DECIMAL") | kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
    falsy = (
        value.isNull()
        | (kind == F.lit("VOID"))
        | ((kind == F.lit("STRING")) & (as_text == F.lit("")))
        | ((kind == F.lit("BOOLEAN")) & (as_text == F.lit("false")))
        | (numeric & (as_number == F.lit(0.0)))
    )
    return F.when(~falsy, F.try_variant_get(value, "$", target))


def strict(raw: Column, parsed: Column, name: str) -> Column:
    """``parsed``, but a job error where ``raw`` has a value that did not parse.

    Spelled out so a malformed field fails the job whatever the session's ANSI
    setting, instead of becoming a silent null.
    """
    message = F.concat(F.lit(f"malformed {name}: "), raw.cast("string"))
    return F.when(raw.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def exact(raw: Column, target: DataType) -> Column:
    """A number given as text, as ``target``; null if ``target`` cannot hold it exactly."""
    number = raw.try_cast("decimal(38,12)")
    held = number.try_cast(target)
    # the text itself must have no digits beyond what the wide decimal keeps
    short = ~raw.rlike(r"\.[0-9]{12}[0-9]*[1-9]") & ~raw.rlike(r"[eE]")
    return F.when(short & (held.try_cast("decimal(38,12)") == number), held)
