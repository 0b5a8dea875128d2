"""Broker tradebook loaders.

A loader maps one broker's export to the canonical tradebook schema
(:data:`holdfast.schemas.TRADEBOOK`). Files are read with every column as a
string, bound by the header of the file it stands in, and then cast: a user
schema would bind CSV columns by position, and neither a broker's column order
nor one order for a whole folder is something to rely on. Reading as strings
also skips the extra pass that schema inference costs.

Every line is accounted for. By default a line that is cut short or too long, a
value that does not parse and an empty key or measure fail the load;
:func:`split_tradebook` gives such lines as a table of their own, with the reason
and the file, and the others as the tradebook.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from holdfast.functions import exact
from holdfast.schemas import TRADEBOOK
from holdfast.sources.csv_files import FILE, LINE, all_accepted, malformed_line, missing_or_malformed, read_csv_by_header

Loader = Callable[[SparkSession, str], DataFrame]
_LOADERS: dict[str, Loader] = {}
_EXPORTS: dict[str, Mapping[str, str]] = {}

# Without one of these an execution says nothing: a ledger has no use for it.
REQUIRED = ("symbol", "trade_date", "trade_type", "quantity", "price")
REJECTED = ["file", "line", "reason"]


def register_loader(broker: str) -> Callable[[Loader], Loader]:
    """Decorator that makes ``read_tradebook(..., broker=name)`` use a function."""

    def wrap(fn: Loader) -> Loader:
        _LOADERS[broker] = fn
        return fn

    return wrap


def register_csv_export(broker: str, names: Mapping[str, str] | None = None) -> None:
    """Make a broker's CSV export known by the names of its columns.

    ``names`` maps canonical columns to the export's; those it leaves out have
    their canonical name. Lines are checked, and can be split, without more code.
    """
    _EXPORTS[broker] = {c: (names or {}).get(c, c) for c in TRADEBOOK.fieldNames()}
    _LOADERS[broker] = lambda spark, path: accepted_lines(_export_lines(spark, path, broker))


def brokers() -> list[str]:
    return sorted(_LOADERS)


def read_tradebook(spark: SparkSession, path: str | list[str], broker: str = "Zerodha") -> DataFrame:
    """Read a broker's tradebook export into the canonical schema; any bad line fails the job."""
    loader = _LOADERS.get(broker)
    if loader is None:
        raise ValueError(f"no tradebook loader for broker {broker!r}; known: {brokers()}")
    return loader(spark, path)


def split_tradebook(spark: SparkSession, path: str | list[str], broker: str = "Zerodha") -> tuple[DataFrame, DataFrame]:
    """(tradebook, rejected lines): every line of the export is in one of them.

    The second has the columns ``file``, ``line`` and ``reason``; of a line with
    the right number of fields, ``line`` holds the canonical ones as CSV. Each
    frame reads the files for itself; ``plans.tradebook.load_tradebook`` writes
    both in one pass.
    """
    lines = parsed_lines(spark, path, broker)
    return lines.where("reason IS NULL").select(*TRADEBOOK.fieldNames()), lines.where("reason IS NOT NULL").select(*REJECTED)


def parsed_lines(spark: SparkSession, path: str | list[str], broker: str = "Zerodha") -> DataFrame:
    """Every line of an export: the canonical columns, ``file``, ``line`` and
    ``reason`` (null where the line is good)."""
    if broker not in _EXPORTS:
        raise ValueError(f"no CSV export known for broker {broker!r}; known: {sorted(_EXPORTS)}")
    raw = _export_lines(spark, path, broker)
    text = F.coalesce(F.col(LINE), F.to_csv(F.struct(*TRADEBOOK.fieldNames())))
    return raw.select(*(_parsed(f.name).alias(f.name) for f in TRADEBOOK.fields), F.col(FILE).alias("file"), text.alias("line"), _reason().alias("reason"))


def _export_lines(spark: SparkSession, path: str | list[str], broker: str) -> DataFrame:
    """The export's lines as text, under the canonical names."""
    names = _EXPORTS[broker]
    raw = read_csv_by_header(spark, path, names.values())
    return raw.select(*(F.col(f"`{theirs}`").alias(ours) for ours, theirs in names.items()), LINE, FILE)


def accepted_lines(raw: DataFrame) -> DataFrame:
    """Lines as text (canonical columns, ``LINE``, ``FILE``) as a tradebook; any bad one fails the job."""
    return all_accepted(raw, _reason()).select(*(_parsed(f.name).alias(f.name) for f in TRADEBOOK.fields))


def _parsed(name: str) -> Column:
    """The canonical column from its text, null where it does not parse.

    A number that its column cannot hold exactly does not parse: a price with
    more than six decimals, a fractional quantity (``10.000000`` is a whole
    number). Nothing is rounded.
    """
    c, target = F.col(name), TRADEBOOK[name].dataType
    if isinstance(target, StringType):
        return c
    if name in ("quantity", "price"):
        return exact(c, target)
    if name == "trade_date":
        return F.try_to_date(c, "yyyy-MM-dd")
    return c.try_cast(target)      # timestamps: wall clock, no zone


def _reason() -> Column:
    """Why a line is rejected: the first thing wrong with it, or null."""
    fields = (missing_or_malformed(f.name, _parsed(f.name), f.name in REQUIRED) for f in TRADEBOOK.fields)
    return F.coalesce(malformed_line(), *fields)


register_csv_export("Zerodha")


def write_tradebook_csv(tradebook: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a tradebook the way the broker exports it (header CSV)."""
    tradebook.write.mode(mode).option("header", True).csv(path)
