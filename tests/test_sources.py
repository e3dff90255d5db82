import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom import cli
from gridloom.engine import Engine
from gridloom.errors import DataSourceError
from gridloom.sources.wide import ColumnMapping, WideParquetSource, WideSource, parquet_time_range, parse_column
from gridloom.types import Matcher, TimeRange

S = 10**9


@pytest.mark.parametrize(
    "column, metadata, expected",
    [
        ("cores", None, ("cores", {})),
        ("irq_served/disk/4", None, ("irq_served", {"op": "disk", "id": "4"})),
        ("spool/merge", None, ("spool", {"op": "merge"})),
        ("c///1", None, ("c", {"cgroup": "/", "id": "1"})),
        ("c//jobs/nightly/77", None, ("c", {"cgroup": "/jobs/nightly", "id": "77"})),
        ("c//alone", None, ("c", {})),
        ("lat/read:buckets", None, ("lat", {"op": "read"})),
        ("x1:buckets", {"unit": "ns", "op": "r"}, ("x1", {"op": "r"})),
        ("x1", {"metric": "m", "unit": "ns", "grouping_power": "3", "max_value_power": "64", "zone": "z"}, ("m", {"zone": "z"})),
    ],
)
def test_columns(column, metadata, expected):
    assert parse_column(column, metadata) == expected


def test_wide_table(spark):
    df = spark.createDataFrame(
        [(s * S, 9, 100.0 * s, 50.0 * s, s, None if s == 2 else 7.0 * s, "text") for s in (1, 2, 3)],
        "timestamp long, duration long, `io/read` double, `io/write` double, `irq/net.x/0` long, `irq/net.x/1` double, note string",
    )
    engine = Engine(WideSource(df))
    at = lambda q, t=3 * S: {tuple(sorted(s.labels.items())): s.value for s in engine.instant_query(q, t).samples}
    assert at("io") == {(("__name__", "io"), ("op", "read")): 300, (("__name__", "io"), ("op", "write")): 150}
    assert at('io{op=~"w.*"}') == {(("__name__", "io"), ("op", "write")): 150} and at('io{op="none"}') == {}
    assert at("sum(increase(io[2s]))") == {(): 300} and len(at("irq", 2 * S)) == 2 and at("sum by (id) (irq)", 2 * S) == {(("id", "0"),): 2, (("id", "1"),): 7}
    for name in ("nothing", "duration", "note"):
        with pytest.raises(DataSourceError):
            engine.instant_query(name, S)
    assert [(m.name, m.label_names) for m in engine.source.list_metrics()] == [("io", ("op",)), ("irq", ("id", "op"))]
    assert [m.name for m in engine.source.list_metrics(Matcher("__name__", "!=", "io"))] == ["irq"]


@pytest.fixture
def telemetry(tmp_path):
    fields = [
        pa.field("timestamp", pa.uint64()), pa.field("duration", pa.uint64()), pa.field("c0", pa.uint64(), metadata={"metric": "cycles", "unit": "n", "cpu": "0"}), pa.field("c1", pa.uint64(), metadata={"metric": "cycles", "cpu": "1"}),
        pa.field("temp/room", pa.float64()), pa.field("hist:buckets", pa.list_(pa.uint64()), metadata={"metric": "hist"}),
    ]
    n = 30
    data = [[(i + 1) * S for i in range(n)], [1] * n, [10 * i for i in range(n)], [20 * i for i in range(n)], [20.5] * n, [[1, 2]] * n]
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.Table.from_arrays([pa.array(d, f.type) for d, f in zip(data, fields)], schema=pa.schema(fields)), path)
    return path


def test_parquet(spark, telemetry):
    r = parquet_time_range(telemetry)
    assert (r.start_ns, r.end_ns) == (S, 30 * S)
    source = WideParquetSource(spark, telemetry)
    assert [(m.name, m.label_names) for m in source.list_metrics()] == [("cycles", ("cpu",)), ("temp", ("op",))]
    frame = Engine(source).instant_frame('sum by (cpu) (rate(cycles{cpu="1"}[5s]))', 30 * S)
    assert [(x["cpu"], x["value"]) for x in frame.df.collect()] == [("1", 20.0)]
    plan = frame.df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<timestamp:decimal(20,0),c1:decimal(20,0)>" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
    with pytest.raises(DataSourceError):
        parquet_time_range(telemetry, "nothing")
    with pytest.raises(DataSourceError):
        WideParquetSource(spark, telemetry + "x")
    assert Engine(WideParquetSource(spark, telemetry, ColumnMapping(ignore_columns=("c1",)))).instant_query("count(cycles)", 30 * S).samples[0].value == 1


def test_command_line(spark, telemetry, capsys):
    assert cli.main(["graph", "sum(rate(m[5m]))"]) == 0 and "aggregate sum" in capsys.readouterr().out
    assert cli.main(["graph", "sum(("]) == 1 and "parse error" in capsys.readouterr().out
    assert cli.main(["plan", "-f", telemetry, "sum(rate(cycles[5s]))", "--physical"]) == 0
    out = capsys.readouterr().out
    assert "== physical" in out and "== logical" not in out
    assert cli.main(["plan", "-f", telemetry, "cycles", "--start", "1", "--end", "9", "--step", "2"]) == 0 and "== optimized" in capsys.readouterr().out
    assert cli.main(["plot", "-f", telemetry, "cycles", "--step", "5"]) == 0
    out = capsys.readouterr().out
    assert "cpu=0" in out and "*" in out
    assert cli.main(["plot", "-f", telemetry, "cycles", "-t", "9000"]) == 0 and "no data" in capsys.readouterr().out


def test_many_files_with_differing_footers(spark, tmp_path):
    """In one file a column stands for another series than in the next; nothing of one file's metadata reaches the other, nor the mapping given."""
    folder = tmp_path / "wide"
    folder.mkdir()
    for k, (meta, kind) in enumerate([({"metric": "m", "zone": "a"}, pa.float64()), ({"metric": "m", "side": "b"}, pa.int64()), (None, pa.float64()), ({"metric": "m", "zone": "a"}, pa.float64())]):
        schema = pa.schema([pa.field("timestamp", pa.int64()), pa.field("c", kind, metadata=meta)])
        pq.write_table(pa.Table.from_arrays([pa.array([(k + 1) * S]), pa.array([10 * (k + 1)], kind)], schema=schema), str(folder / f"{k}.parquet"))
    mapping = ColumnMapping()
    source = WideParquetSource(spark, str(folder), mapping)
    assert mapping == ColumnMapping() and len(source.parts) == 3
    assert [(m.name, m.label_names) for m in source.list_metrics()] == [("c", ()), ("m", ("side", "zone"))]
    engine = Engine(source)
    assert {(s.labels.get("zone"), s.labels.get("side"), s.value) for s in engine.instant_query("m", 4 * S).samples} == {("a", None, 40), (None, "b", 20)}
    assert {s.value for s in engine.instant_query('m{zone=""}', 4 * S).samples} == {20} and {s.value for s in engine.instant_query("c", 4 * S).samples} == {30}
    assert parquet_time_range(str(folder)) == TimeRange(S, 4 * S) and parquet_time_range(str(folder / "[12].parquet")) == TimeRange(2 * S, 3 * S)
