"""Securities master: snapshot cleaning, refresh, CSV hand-over, lookups."""

from __future__ import annotations

import json
import os
from decimal import Decimal

import pytest
from conftest import rows

from holdfast import refresh_securities, scratch_dir
from holdfast.operators import (
    lookup_codes,
    normalise_securities,
    segment_audit,
    segment_code,
    segment_slug,
    unknown_symbols,
)
from holdfast.schemas import SECURITIES
from holdfast.sources import read_securities_csv, read_snapshots, write_securities_csv
from holdfast.sources.securities import read_securities_table


def _write_json(path, segment, payload, lines=False):
    folder = os.path.join(path, f"segment={segment}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "part-0.json"), "w") as fh:
        if lines:
            fh.write("\n".join(json.dumps(r) for r in payload))
        else:
            json.dump(payload, fh)


@pytest.fixture
def snapshot_dir(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    _write_json(path, "Equity T+1", [
        {"SCRIP_CD": "500001", "Scrip_Name": "Alpha", "Status": "Active", "GROUP": "A ",
         "FACE_VALUE": "10.00", "ISIN_NUMBER": "INE1", "INDUSTRY": "", "scrip_id": "ALPHA",
         "NSURL": None, "Issuer_Name": "Alpha Ltd", "Mktcap": 0},
        {"SCRIP_CD": "500002", "Scrip_Name": "Beta", "Status": "Delisted", "GROUP": "0",
         "FACE_VALUE": 2, "ISIN_NUMBER": "INE2", "scrip_id": "BETA", "Mktcap": "1234.5"},
    ])
    _write_json(path, "Derivatives", [{"SCRIP_CD": "800001", "scrip_id": "FUT", "Status": "Active",
                                       "FACE_VALUE": 0.0}], lines=True)
    return path


def test_normalise_falsy_values_become_null(spark, snapshot_dir):
    got = {r["scrip_code"]: r for r in normalise_securities(read_snapshots(spark, snapshot_dir)).collect()}
    alpha, beta, fut = got["500001"], got["500002"], got["800001"]
    assert alpha["segment"] == "Equity T+1" and alpha["industry"] is None and alpha["nsurl"] is None
    assert alpha["market_cap"] is None            # numeric 0
    assert alpha["face_value"] == Decimal("10.0000")
    assert alpha["group_name"] == "A "
    assert beta["group_name"] == "0"              # the string "0" stays
    assert beta["industry"] is None               # key absent
    assert beta["market_cap"] == Decimal("1234.5000")
    assert fut["face_value"] is None              # 0.0
    assert fut["segment"] == "Derivatives"


def test_refresh_writes_once_and_audits(spark, snapshot_dir):
    table = scratch_dir(spark, "test-master")
    audit = refresh_securities(spark, snapshot_dir, table)
    loaded = {r["segment"]: r["rows"] for r in audit.collect()}
    assert {k: v for k, v in loaded.items() if v} == {"Derivatives": 1, "Equity T+1": 2}
    assert loaded["Commodity"] == 0 and len(loaded) == 15          # a segment without a snapshot has its line
    master = read_securities_table(spark, table)
    assert master.filter("segment = 'Derivatives'").count() == 1
    plan = master.filter("segment = 'Equity T+1' AND scrip_id = 'BETA'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan and "PushedFilters: [IsNotNull(scrip_id), EqualTo(scrip_id,BETA)]" in plan
    ids = [r["id"] for r in master.collect()]
    assert len(set(ids)) == 3 and all(isinstance(i, int) for i in ids)


def test_csv_roundtrip_and_strict_header(spark, tmp_path):
    df = spark.createDataFrame(
        [("Equity T+1", "500001", "Alpha, Ltd", "Active", None, Decimal("1.0000"), None, None, "ALPHA",
          None, None, Decimal("12.5000"))], SECURITIES)
    path = scratch_dir(spark, "test-csv")
    write_securities_csv(df, path)
    assert rows(read_securities_csv(spark, path)) == rows(df)
    bad = str(tmp_path / "bad" / "segment=X")
    os.makedirs(bad)
    with open(os.path.join(bad, "f.csv"), "w") as fh:
        fh.write("wrong,header\n1,2\n")
    with pytest.raises(Exception):
        read_securities_csv(spark, str(tmp_path / "bad")).collect()


@pytest.fixture
def master(spark):
    data = [("Equity T+1", "500001", "A", "Active", "AAA"), ("Equity T+1", "500002", "B", "Suspended", "BBB"),
            ("Equity T+1", "500009", "B2", "Suspended", "BBB"), ("Derivatives", "800001", "C", "Active", "CCC")]
    return spark.createDataFrame(data, "segment string, scrip_code string, security_name string, status string, scrip_id string")


def _tickers(spark, names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_lookup_keeps_unknown_tickers(spark, master):
    got = rows(lookup_codes(_tickers(spark, ["AAA", "BBB", "ZZZ"]), master))
    assert got == [("AAA", "500001"), ("BBB", "500002"), ("ZZZ", None)]   # smallest code wins
    assert rows(unknown_symbols(_tickers(spark, ["AAA", "ZZZ"]), master)) == [("ZZZ",)]


def test_lookup_defaults(spark, master):
    t = _tickers(spark, ["AAA", "CCC"])
    # unknown segment -> Equity T+1; unknown status -> no status filter
    assert rows(lookup_codes(t, master, segment="Nope", status="Weird")) == [("AAA", "500001"), ("CCC", None)]
    assert rows(lookup_codes(t, master, segment="Derivatives", status="Active")) == [("AAA", None), ("CCC", "800001")]
    assert rows(lookup_codes(t, master, status="Suspended")) == [("AAA", None), ("CCC", None)]


def test_lookup_empty_ticker_list(spark, master):
    assert lookup_codes(_tickers(spark, []), master).collect() == []


def test_lookup_filters_reach_the_scan(spark, master):
    path = scratch_dir(spark, "test-lookup")
    master.write.partitionBy("segment").parquet(path)
    plan = lookup_codes(_tickers(spark, ["AAA"]), spark.read.parquet(path), status="Active")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,Active)" in text and "PartitionFilters: [isnotnull(segment" in text


def test_segment_codes_and_slug(spark):
    df = spark.createDataFrame([("Equity T+1",), ("Exchange Traded Funds",), ("Social Stock Exchange",), ("Unknown",)],
                               "segment string")
    got = rows(df.select("segment", segment_code("segment").alias("code"), segment_slug("segment").alias("slug")))
    assert got == [("Equity T+1", "Equity", "equity_t_1"), ("Exchange Traded Funds", "MF", "exchange_traded_funds"),
                   ("Social Stock Exchange", "SSE", "social_stock_exchange"), ("Unknown", "Equity", "unknown")]


def test_segment_audit(spark, master):
    assert rows(segment_audit(master, [])) == [("Derivatives", 1), ("Equity T+1", 3)]
    assert rows(segment_audit(master, ["Derivatives", "Commodity"])) == [("Commodity", 0), ("Derivatives", 1), ("Equity T+1", 3)]


def test_csv_ingest_appends_into_the_master_table(spark):
    from holdfast.plans.securities import ingest_securities_csv

    df = spark.createDataFrame(
        [("Equity T+1", "500001", "Alpha", "Active", None, Decimal("1.0000"), None, None, "ALPHA", None, None, None),
         ("Derivatives", "800001", "Fut", "Active", None, None, None, None, "FUT", None, None, None)], SECURITIES)
    csv, table = scratch_dir(spark, "test-ingest-csv"), scratch_dir(spark, "test-ingest-table")
    write_securities_csv(df, csv)
    first = ingest_securities_csv(spark, csv, table)
    assert first.count() == 2 and first.schema["segment"].dataType.simpleString() == "string"
    again = ingest_securities_csv(spark, csv, table)           # COPY semantics: appends
    assert rows(segment_audit(again, [])) == [("Derivatives", 2), ("Equity T+1", 2)]
    assert again.select("id").distinct().count() == 4


def test_master_layout_splits_a_large_segment_into_sorted_files(spark):
    from pyspark.sql import functions as F

    from holdfast.plans.securities import write_master
    from holdfast.operators import with_security_id

    big = [("Equity T+1", f"5{i:05d}", f"N{i}", "Active", None, None, None, None, f"S{i:04d}", None, None, None)
           for i in range(400)]
    small = [("Derivatives", "800001", "F", "Active", None, None, None, None, "FUT", None, None, None)]
    table = scratch_dir(spark, "test-layout")
    # at this size adaptive execution would rightly merge everything into one
    # file; without merging, the layout shows what a large segment gets
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        write_master(with_security_id(spark.createDataFrame(big + small, SECURITIES)), table)
    finally:
        spark.conf.set(key, before)
    files = (read_securities_table(spark, table).filter("segment = 'Equity T+1'")
             .groupBy(F.input_file_name().alias("f"))
             .agg(F.min("scrip_id").alias("lo"), F.max("scrip_id").alias("hi")).collect())
    assert len(files) > 1                      # one big segment, several files
    ranges = sorted((r["lo"], r["hi"]) for r in files)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))   # disjoint scrip_id ranges


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_corrupt_snapshot_line_fails(spark, tmp_path, ansi):
    folder = tmp_path / "snap" / "segment=Equity T+1"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"SCRIP_CD": "1"}\n{"SCRIP_CD": "2"\n{"SCRIP_CD": "3"}\n')
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception):
            normalise_securities(read_snapshots(spark, str(tmp_path / "snap"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_a_failing_refresh_keeps_the_table(spark, snapshot_dir, tmp_path):
    table = scratch_dir(spark, "test-atomic")
    refresh_securities(spark, snapshot_dir, table)
    before = read_securities_table(spark, table)          # planned before the next refreshes
    want = rows(before)
    bad = tmp_path / "bad" / "segment=Equity T+1"
    bad.mkdir(parents=True)
    (bad / "a.json").write_text('{"SCRIP_CD": ')
    with pytest.raises(Exception):
        refresh_securities(spark, str(tmp_path / "bad"), table)
    assert rows(read_securities_table(spark, table)) == want
    refresh_securities(spark, snapshot_dir, table)
    assert rows(before) == want                           # the version a reader holds stays one more refresh
    assert rows(read_securities_table(spark, table)) == want
    refresh_securities(spark, snapshot_dir, table)
    assert len([f for f in os.listdir(table) if f.startswith("load=")]) == 2


def test_readers_never_see_an_empty_table(spark, snapshot_dir):
    import threading

    table = scratch_dir(spark, "test-readers")
    refresh_securities(spark, snapshot_dir, table)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(read_securities_table(spark, table).count())
            except Exception as e:  # noqa: BLE001
                seen.append(repr(e))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for _ in range(2):
            refresh_securities(spark, snapshot_dir, table)
    finally:
        stop.set()
        reader.join()
    assert seen and set(seen) == {3}


def test_ids_are_a_key_also_for_repeated_and_null_codes(spark):
    from holdfast.operators import with_security_id

    row = ("Equity T+1", None, "Alpha", "Active", None, None, None, None, "ALPHA", None, None, None)
    other = ("Equity T+1", None, "Beta", "Active", None, None, None, None, "BETA", None, None, None)
    df = with_security_id(spark.createDataFrame([row, row, other, row], SECURITIES))
    assert len({r["id"] for r in df.collect()}) == 4


SECURITY = ("Equity T+1", "500001", "Alpha", "Active", None, None, None, None, "ALPHA", None, None, None)


def _csv_of(spark, name, *codes):
    path = scratch_dir(spark, name)
    write_securities_csv(spark.createDataFrame([(SECURITY[0], c, *SECURITY[2:]) for c in codes], SECURITIES), path)
    return path


def test_concurrent_ingests_keep_all_rows(spark):
    from concurrent.futures import ThreadPoolExecutor

    from holdfast.plans.securities import ingest_securities_csv

    table = scratch_dir(spark, "test-concurrent")
    files = [_csv_of(spark, f"test-half-{k}", f"50000{k}", "500009") for k in range(4)]     # one record in all of them
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda f: ingest_securities_csv(spark, f, table), files))
    master = read_securities_table(spark, table)
    assert sorted(r["scrip_code"] for r in master.collect()) == sorted([f"50000{k}" for k in range(4)] + ["500009"] * 4)
    assert master.select("id").distinct().count() == 8
    plan = master.filter("segment = 'Equity T+1'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(segment" in plan


def test_a_commit_that_lost_the_race_is_rebased(spark):
    """Two writers that both saw the same table: the second lists the first one's rows too."""
    from holdfast.operators import with_security_id
    from holdfast.session import create_file_if_absent
    from holdfast.sources import securities as src

    table = scratch_dir(spark, "test-race")
    folders = [src.new_data_folder() for _ in range(3)]
    for k, folder in enumerate(folders):
        rows_ = spark.createDataFrame([(SECURITY[0], f"50000{k}", *SECURITY[2:])], SECURITIES)
        src.write_data(with_security_id(rows_, load=folder), table, folder)
    src.commit(spark, table, folders[0], append=True)
    taken = os.path.join(table, src.COMMITS, "000000000002.json")
    assert create_file_if_absent(spark, taken, json.dumps(folders[:2]))       # the other writer, meanwhile
    assert not create_file_if_absent(spark, taken, "[]")                      # a name is given once
    assert json.load(open(taken)) == folders[:2]
    src.commit(spark, table, folders[2], append=True)
    assert sorted(r["scrip_code"] for r in read_securities_table(spark, table).collect()) == ["500000", "500001", "500002"]
    assert src.commits(spark, table) == [f"{n:012d}.json" for n in (1, 2, 3)]


def test_cleaning_up_leaves_unfinished_writes_alone(spark, snapshot_dir):
    from holdfast.sources import securities as src

    table = scratch_dir(spark, "test-orphans")
    refresh_securities(spark, snapshot_dir, table)
    os.makedirs(os.path.join(table, "load=unfinished"))
    for _ in range(3):
        refresh_securities(spark, snapshot_dir, table)
    left = sorted(f for f in os.listdir(table) if f.startswith("load="))
    assert len(left) == 3 and "load=unfinished" in left
    src.remove_old_versions(spark, table, orphan_hours=0)
    assert "load=unfinished" not in os.listdir(table)
    assert read_securities_table(spark, table).count() == 3


def test_a_refresh_does_not_read_its_table_again(spark, snapshot_dir):
    audit = refresh_securities(spark, snapshot_dir, scratch_dir(spark, "test-audit"))
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan


def test_bloom_filters_skip_row_groups(spark):
    from pyspark.sql import functions as F

    from holdfast.operators import lookup_securities, securities_by, with_security_id
    from holdfast.sources import securities as src

    # codes and ISINs in no order, so that no row group can be left out by its range
    rows_ = spark.range(60_000).select(
        F.lit("Equity T+1").alias("segment"), F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("scrip_code"),
        *(F.lit(None).cast(SECURITIES[c].dataType).alias(c) for c in ("security_name", "status", "group_name", "face_value")),
        F.substring(F.md5(F.concat(F.lit("i"), F.col("id"))), 1, 12).alias("isin_number"), F.lit(None).cast("string").alias("industry"),
        F.format_string("S%06d", F.col("id")).alias("scrip_id"),
        *(F.lit(None).cast(SECURITIES[c].dataType).alias(c) for c in ("nsurl", "issuer_name", "market_cap")))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(256 << 10))
    table, folder = scratch_dir(spark, "test-bloom"), src.new_data_folder()
    try:
        src.write_data(with_security_id(rows_).coalesce(1).sortWithinPartitions("scrip_id"), table, folder)
    finally:
        hadoop.unset("parquet.block.size")
    src.commit(spark, table, folder, append=False)
    master = read_securities_table(spark, table)

    def scanned(df):
        got = df.collect()
        node = df._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().apply(0)
        return len(got), node.metrics().apply("numOutputRows").value()

    code = master.where("scrip_id = 'S031000'").first()
    for key in ("scrip_code", "isin_number"):
        found, read = scanned(securities_by(master, key, [code[key], *(f"none{i}" for i in range(14))]))
        assert found == 1 and 0 < read < 30_000, (key, read)
        assert scanned(securities_by(master, key, ["none"])) == (0, 0)
    # the same without the filters reads more
    hadoop.set("parquet.filter.bloom.enabled", "false")
    try:
        assert scanned(securities_by(read_securities_table(spark, table), "scrip_code", [code["scrip_code"]]))[1] > read
    finally:
        hadoop.unset("parquet.filter.bloom.enabled")
    wanted = spark.createDataFrame([(code["isin_number"],), ("none",), ("none",)], "isin_number string")
    assert rows(lookup_securities(wanted, master, "isin_number"), "isin_number", "scrip_id") == sorted([(code["isin_number"], "S031000"), ("none", None)])
    with pytest.raises(ValueError, match="key must be"):
        securities_by(master, "industry", ["x"])


LAYOUTS = {
    "indented": lambda r: json.dumps(r, indent=4),
    "tabs": lambda r: json.dumps(r, indent="\t").replace("\n", "\r\n"),
    "side by side": lambda r: "[" + ", ".join(json.dumps(x, indent=1) for x in r) + "]",
    "one line": lambda r: json.dumps(r),
    "a record a line": lambda r: "[\n" + ",\n".join(map(json.dumps, r)) + "\n]\n",
    "no array": lambda r: "\n".join(json.dumps(x, indent=2) for x in r),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_records_laid_out_over_lines(spark, tmp_path, layout):
    tricky = ['a } b', '{"x": [1, 2]}', 'quote " and }, {', "back\\slash \\", '"},{"', "}\n{", "[", "", "größe }"]
    records = [{"SCRIP_CD": str(i), "Scrip_Name": tricky[i % len(tricky)], "Mktcap": {"nested": [{"a": 1}, {"b": {}}]} if i % 5 == 0 else i,
                "scrip_id": f"S{i}"} for i in range(300)]
    spread, plain = str(tmp_path / "spread"), str(tmp_path / "plain")
    for segment, part in (("Equity T+1", records), ("007", records[:7]), ("Commodity", [])):
        _write_json(plain, segment, part, lines=True)
        folder = os.path.join(spread, f"segment={segment}")
        os.makedirs(folder)
        with open(os.path.join(folder, "part-0.json"), "w", newline="") as fh:
            fh.write(LAYOUTS[layout](part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")       # many splits, most borders inside a record
    try:
        got = read_snapshots(spark, spread, multi_line=True)
        tasks = spark.read.text(os.path.join(spread, "segment=Equity T+1")).rdd.getNumPartitions()
        as_rows = lambda df: sorted(tuple(None if v is None else str(v) for v in r) for r in df.collect())
        assert tasks > 3 and as_rows(got) == as_rows(read_snapshots(spark, plain).select(got.columns))
        assert got.schema["segment"].dataType.simpleString() == "string"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ['[\n{"SCRIP_CD": "1"},\n{"SCRIP_CD": \n]', '[\n{"SCRIP_CD": "1"\n', "[1, 2]", '[{"SCRIP_CD": "1"} x]'])
def test_broken_spread_snapshots_fail(spark, tmp_path, text):
    folder = tmp_path / "snap" / "segment=Equity T+1"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(text)
    with pytest.raises(Exception):
        read_snapshots(spark, str(tmp_path / "snap"), multi_line=True).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_numbers_that_are_none_fail_or_are_counted(spark, tmp_path, ansi):
    from holdfast.operators import bad_numbers_audit

    path = str(tmp_path / "snap")
    _write_json(path, "Equity T+1", [{"SCRIP_CD": "1", "FACE_VALUE": "n/a", "Mktcap": "12"}, {"SCRIP_CD": "2", "FACE_VALUE": "n/a"},
                                     {"SCRIP_CD": "3", "FACE_VALUE": "", "Mktcap": True}, {"SCRIP_CD": "4", "FACE_VALUE": 5}], lines=True)
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        snapshots = read_snapshots(spark, path)
        with pytest.raises(Exception, match="malformed face_value: n/a"):
            normalise_securities(snapshots).where("scrip_code < '3'").select("face_value").collect()
        lenient = normalise_securities(snapshots, bad_numbers="null")
        assert rows(lenient, "scrip_code", "face_value")[0] == ("1", None)
        assert {tuple(r) for r in bad_numbers_audit(snapshots).collect()} >= {("Equity T+1", "face_value", "n/a", 2)}
        with pytest.raises(ValueError):
            normalise_securities(snapshots, bad_numbers="maybe")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
