"""Readers and writers: broker tradebooks, price and event feeds, securities master."""

from holdfast.sources.market import read_events, read_prices
from holdfast.sources.securities import (
    read_securities_csv,
    read_securities_jdbc,
    read_securities_table,
    read_snapshots,
    write_securities_csv,
    write_snapshots,
)
from holdfast.sources.tradebook import (
    brokers,
    parsed_lines,
    read_tradebook,
    register_csv_export,
    register_loader,
    split_tradebook,
    write_tradebook_csv,
)

__all__ = [
    "brokers",
    "parsed_lines",
    "read_events",
    "read_prices",
    "read_securities_csv",
    "read_securities_jdbc",
    "read_securities_table",
    "read_snapshots",
    "read_tradebook",
    "register_csv_export",
    "register_loader",
    "split_tradebook",
    "write_securities_csv",
    "write_snapshots",
    "write_tradebook_csv",
]
