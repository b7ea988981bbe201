"""The registered XES format: equal to the plain reader for any ranges, gzip, columns asked for, cases, streams."""

import gzip
import io
import random

import pytest
from pyspark.sql.types import StructType

from millrace.model import BRONZE_CASES
from millrace.sources import xes, xes_format
from test_pipeline import EVENT, TRACE, log_text

COLUMNS = ["case_id", "activity", "timestamp", "resource", "user", "event_value", "event_seq"]


def log(seed, n=60):
    """Traces of many sizes, some empty, repeated ids, odd values, references, repeated keys, nested attributes."""
    rng, out = random.Random(seed), []
    for k in range(n):
        events = "".join(EVENT.format(
            a=rng.choice(["Create &amp; check", "Größe &lt;x&gt;", "Clear Invoice"]),
            t=rng.choice(["2018-03-04T10:00:00.123+02:00", "2018-03-04T10:00:00Z", "2018-03-04T10:00:00.5+00:00", "no time"]),
            more=rng.choice(["", '<string key="org:resource" value="batch_01"/>', '<string key="User" value="u"/><float key="Cumulative net worth (EUR)" value="odd"/>',
                             '<float key="Cumulative net worth (EUR)" value="1.5"/><float key="Cumulative net worth (EUR)" value="-2e3"/>',
                             '<string key="other" value="1"><string key="org:resource" value="nested"/></string>']))
            for _ in range(rng.choice([0, 1, 5, 40])))
        out.append("<trace/>" if k % 17 == 5 else TRACE.format(case=f"c{k % 50}", category="2-way match", vendor=f"v{rng.randint(0, 9)}", events=events))
    return log_text(out)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    xes_format.register(spark)
    path = tmp_path_factory.mktemp("xes") / "log.xes"
    path.write_text(log(1))
    return path


def rows(df, columns=COLUMNS):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("width", [97, 1000, 1 << 20])
def test_events_equal_the_plain_reader(spark, source, width):
    got = spark.read.format("xes").option("rangeBytes", width).load(str(source))
    assert rows(got) == rows(xes.bronze_events(xes.read_traces(spark, str(source)))) and got.count() > 300
    assert got.rdd.getNumPartitions() == -(-source.stat().st_size // width)


def test_cases_equal_the_plain_reader(spark, source):
    cases = spark.read.format("xes").option("table", "cases").option("rangeBytes", 500).load(str(source))
    first = xes_format.first_cases(cases)
    assert rows(first, BRONZE_CASES.names) == rows(xes.bronze_cases(xes.read_traces(spark, str(source))), BRONZE_CASES.names)
    assert first.columns == BRONZE_CASES.names and cases.count() == 60


def test_gzip_uri_and_places(spark, source, tmp_path):
    packed = tmp_path / "log.xes.gz"
    packed.write_bytes(gzip.compress(source.read_bytes()))
    a, b = (spark.read.format("xes").option("rangeBytes", 300).load(p) for p in (str(packed), source.as_uri()))
    columns = [*COLUMNS, "trace_offset"]
    assert rows(a, columns) == rows(b, columns) and a.rdd.getNumPartitions() == 1
    text = source.read_bytes()
    assert all(text[r.trace_offset:].startswith(b"<trace") for r in b.select("trace_offset").distinct().collect())


def test_only_what_is_asked_for(spark, source):
    schema = "event_seq long, activity string"
    assert rows(spark.read.format("xes").schema(schema).load(str(source)), ["activity"]) == rows(spark.read.format("xes").load(str(source)), ["activity"])
    reader = xes_format.XesRows(StructType.fromDDL(schema), "events")
    assert reader.of_case == {} and list(reader.of_event) == ["concept:name"]
    with pytest.raises(Exception, match="no column"):
        spark.read.format("xes").schema("colour string").load(str(source)).collect()


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_ranges_give_each_trace_once(monkeypatch, block):
    monkeypatch.setattr(xes_format, "BLOCK", block)
    text = ("<log><traces/><trace a='1'>" + "x" * 40 + "</trace><trace/><trace >é</trace>\n<trace>" + "<event/>" * 9 + "</trace><trace>cut").encode()
    whole = list(xes_format.traces(io.BytesIO(text).read, 0, None))
    assert [t[:7] for _, t in whole] == [b"<trace ", b"<trace/", b"<trace ", b"<trace>"] and all(text[o:].startswith(t) for o, t in whole)
    for width in (1, 5, 33, 1000):
        got = []
        for a in range(0, len(text), width):
            stream = io.BytesIO(text)
            stream.seek(a)
            got += xes_format.traces(stream.read, a, min(a + width, len(text)))
        assert got == whole


def test_odd_logs(spark, source, tmp_path):
    (tmp_path / "empty.xes").write_text("")
    assert spark.read.format("xes").load(str(tmp_path)).count() == 0
    (tmp_path / "_hidden.xes").write_text(source.read_text())
    assert spark.read.format("xes").load(str(tmp_path)).count() == 0
    (tmp_path / "bad.xes").write_text("<log><trace><event></trace></log>")
    with pytest.raises(Exception, match="at byte 5 is not well-formed"):
        spark.read.format("xes").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="events or cases"):
        spark.read.format("xes").option("table", "x").load(str(tmp_path)).collect()


def test_stream_of_a_folder(spark, tmp_path):
    xes_format.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        query = (spark.readStream.format("xes").option("rangeBytes", 2000).load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination(120)
        assert query.exception() is None
        return rows(spark.read.parquet(str(tmp_path / "out")))

    (folder / "a.xes").write_text(log(2, 12))
    first = run()
    assert first == rows(xes.bronze_events(xes.read_traces(spark, str(folder)))) and run() == first  # nothing new, nothing twice
    (folder / "b.xes").write_text(log(3, 12))
    assert run() == rows(xes.bronze_events(xes.read_traces(spark, str(folder)))) != first


def test_many_ranges_share_tasks(source, monkeypatch):
    """Tasks stay bounded however small the ranges, each range is still read as one, and reads no further than it needs."""
    monkeypatch.setattr(xes_format, "TASKS", 20)
    wanted = xes_format.XesRows(xes_format.EVENTS, "events")

    def tasks(width):
        reader = xes_format.XesReader(wanted, str(source), width)
        parts = reader.partitions()
        return len(parts), [row for p in parts for batch in reader.read(p) for row in batch.to_pylist()]

    whole = tasks(1 << 20)
    assert whole[0] == 1
    for width in (97, 1000):
        n, got = tasks(width)
        assert n <= 30 and got == whole[1]
    stream = io.BytesIO(source.read_bytes() * 40)
    list(xes_format.traces(stream.read, 0, 50_000))
    assert stream.tell() <= 150_000
