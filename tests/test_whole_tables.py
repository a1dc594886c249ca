"""Queries over whole tables, at a size where a subset of ids would show."""

import duckdb
import pytest

from tests.test_queries import QUERIES, SQL, TABLES, rows


@pytest.mark.parametrize("name", ["ingest_scan_reports", "events_timeline", "enrich_as_of", "price_series"])
def test_whole_tables(name, spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(c.execute(SQL[name]).df())


def test_scan_reports_take_little_disk(spark, sf, tmp_path, monkeypatch):
    """Reports are compressed, in files of a bounded number of hosts, and their table holds nothing that is derived."""
    import gzip

    from harrow.plans import queries_streaming

    monkeypatch.setattr(queries_streaming, "_target", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(queries_streaming, "HOSTS_PER_FILE", 200, raising=False)
    found = QUERIES["ingest_scan_reports"](spark, sf)
    hosts = [gzip.decompress(f.read_bytes()).count(b"<host ") for f in (tmp_path / "xml").glob("part-*") if f.name.endswith(".xml.gz")]
    assert sum(hosts) > 1000 and max(hosts) <= 200
    assert {c for f in found.inputFiles() for c in spark.read.parquet(f).columns} == {"ip", "started", "os_guess", "port", "script"}
