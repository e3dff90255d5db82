import datetime as dt
import json

import pytest

from gridloom.operators.drift import _identity, long_table, match_renames, name_agreement, plain_name, schema_changes

FILES = "file_id long, agent string, path string, written_at timestamp_ntz, arrived_at timestamp_ntz, timestamp_column string, ignore_columns array<string>, header string, n long, field string"
RECORDS = "record_id long, file_id long, line_no int, payload string, v string"


def tables(spark, files, records):
    t = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)
    f = [(i, agent, path, None if n is None else t(n), t(1), ts, ignored, header, 1, "x") for i, agent, path, n, ts, ignored, header in files]
    r = [(k, i, line, p if p is None or isinstance(p, str) else json.dumps(p), "x") for k, (i, line, p) in enumerate(records)]
    return spark.createDataFrame(f, FILES), spark.createDataFrame(r, RECORDS)


def header(**fields):
    return json.dumps([{"name": "ts", "type": "uint64"}, *[{"name": k, "type": "string", "metadata": v} for k, v in fields.items()]])


@pytest.fixture(scope="module")
def drifting(spark):
    files = [
        (1, "a", "p1", 1, "ts", ["duration"], None),
        (2, "a", "p2", 2, "ts", None, None),
        (3, "a", "p2", 2, "ts", [], None),  # the same again
        (4, "a", "p3", 3, "ts2", ["duration"], None),
        (5, "a", "p4", 4, "ts", [], None),
        (10, "m", "q1", 1, "ts", [], header(c0={"metric": "irq", "unit": "n", "id": "0", "op": "x"}, c1={"metric": "irq", "id": "1", "op": "y"})),
        (11, "m", "q2", 2, "ts", [], header(c0={"metric": "irq", "core": "0", "op": "x"}, col_9={"metric": "irq", "core": "1", "op": "y"})),
        (12, "m", "q3", 3, "ts", [], None),
        (13, "m", "q4", 4, "ts", [], header(c0={"metric": "irq", "core": "0", "op": "x", "zone": "z"}, col_9={"metric": "irq", "core": "1", "op": "y", "zone": "z"})),
        (20, None, None, None, None, None, "no json"),
    ]
    two = {"ts": 20, "irqServed0": 101, "heat": 1.5, "note": 5, "duration": 3, "host.load": [1, 2]}
    records = [
        (1, 1, {"ts": 10, "duration": 1, "irq_served/0": 100, "heat": 1.25, "note": 5, "load": [1], "gone": 1}),
        (1, 1, {"ts": 10, "duration": 1, "irq_served/0": 100, "heat": 1.25, "note": 5, "load": [1], "gone": 1}),
        (1, 2, {"ts": 11, "heat": 2}),
        (1, 3, None),
        (1, 4, "{broken"),
        (2, 1, two),
        (3, 1, two),
        (4, 1, {"ts2": 30, "irqServed0": None, "heat": 2.5, "note": "5", "duration": 4, "host.load": [], "gone": 2}),
        (5, 1, {"ts": 40, "irqServed0": 103.5, "heat": 2.75, "note": None, "col_7": [3], "gone": 2}),
        (10, 1, {"ts": 1, "c0": 5, "c1": 70}),
        (11, 1, {"ts": 2, "c0": 6, "col_9": 71}),
        (12, 1, {"ts": 3, "c0": 7, "col_9": 72}),
        (13, 1, {"ts": 4, "c0": 8, "col_9": 73}),
    ]
    return tables(spark, files, records)


def test_changes(drifting):
    got = sorted(tuple(r) for r in schema_changes(*drifting).collect())
    assert got == sorted(
        [
            (2, "renamed", "irq_served/0", "irqServed0"), (2, "renamed", "load", "host.load"), (2, "removed", "gone", ""), (2, "added", "", "duration"),
            (4, "type_changed", "note", "note"), (4, "added", "", "gone"), (4, "removed", "duration", ""),
            (5, "type_changed", "irqServed0", "irqServed0"), (5, "renamed", "host.load", "col_7"),
            (11, "renamed", "c1", "col_9"), (11, "label_renamed", "irq{id}", "irq{core}"), (13, "label_added", "", "irq{zone}"),
        ]
    )


def test_long_table(drifting):
    rows = {(r["file_id"], r["__name__"], r["labels"], r["timestamp_ns"]): r["value"] for r in long_table(*drifting).collect()}
    assert rows[1, "irq_served", '{"op": "0"}', 10] == 100 and rows[2, "irq_served", '{"op": "0"}', 20] == 101 and rows[5, "irq_served", '{"op": "0"}', 40] == 103.5
    assert rows[4, "note", "{}", 30] == 5 and (3, "heat", "{}", 20) not in rows
    assert rows[11, "irq", '{"core": "1", "op": "y"}', 2] == 71 and rows[12, "irq", '{"core": "1", "op": "y"}', 3] == 72
    assert not any(k[1] == "duration" and k[0] == 1 for k in rows)


def test_names_and_matches():
    agree = lambda a, b: name_agreement(plain_name(a), plain_name(b))
    assert agree("irq_served/sched/1", "irqServed.SCHED1") == 2
    for other in ("host.irq_served/sched/1", "irq_served_anything/sched/1", "irq_srvd/sched/1", "irqServedSched1Total"):
        assert agree("irq_served/sched/1", other) == agree(other, "irq_served/sched/1") == 1
    assert agree("irq_served/sched/1", "irq_served/sched/2") == 0 and agree("page_misses", "col_1") == 0
    row = lambda f, v=None, t="whole", m=None, move=None: {"field": f, "value": v, "type": t, "meta": m, "move": move}
    assert match_renames([row("irq_served/net/0"), row("net_frames")], [row("irq_srvd/net/0"), row("irq_served/net/1")]) == [("irq_served/net/0", "irq_srvd/net/0")]
    # by values alone only within what a series moves, each field once, the closest first
    assert match_renames([row("a", 100.0, move=0.1), row("b", 500.0, move=3.0), row("e", 501.0, move=3.0)], [row("col_1", 505.0), row("c", 101.0)]) == [("e", "col_1")]
    assert match_renames([row("load", 5.0, "list")], [row("host_load", 90.0, "list")]) == [("load", "host_load")] and match_renames([row("load", 5.0)], [row("host_load", 90.0)]) == []
    assert match_renames([row("x", 7.0, m='{"metric": "a"}', move=1.0)], [row("y", 7.0, m='{"metric": "b"}')]) == []
    assert match_renames([row("a", 1.0, "list")], [row("col_1", 1.0)]) == [] and match_renames([row("a", 1.0)], [row("col_1", 9.0)]) == []
    assert match_renames([row("a", -5.0, move=1.0)], [row("col_1", -5.5)]) == [("a", "col_1")] and match_renames([], []) == []


def test_whole_numbers_stay_exact(spark):
    big = 2**64 - 3
    files, records = tables(spark, [(1, "a", "p", 1, "ts", [], None), (2, "a", "q", 2, "ts", [], None)], [(1, 1, f'{{"ts": 1, "n": {big}, "x": 1}}'), (2, 1, f'{{"ts": 2, "N": {big + 2}, "x": 1.5}}')])
    rows = {(r["__name__"], r["timestamp_ns"]): r for r in long_table(files, records).collect()}
    assert rows["n", 1]["exact"] == big and rows["n", 2]["exact"] == big + 2 and rows["n", 1]["value"] == float(big)
    assert rows["x", 1]["exact"] is None and rows["x", 2]["value"] == 1.5  # of a series that has decimals, no value is cast to a whole number


def test_long_table_is_whole(spark):
    volts = json.dumps([{"name": "v", "type": "string", "metadata": {"metric": "v", "unit": "volts"}}])
    files = [(1, "a", "p", 1, "ts", ["skip", None], None), (2, "a", "p", 2, "ts", [], None), (3, None, "p", 1, "ts", [], volts), (4, "a", None, 5, None, [], None), (5, "a", None, 5, None, [], None)]
    big = 2**64 - 3
    records = [
        (1, 1, f'{{"ts": 1, "w/io:buckets": [7, null, {big}], "mixed": 1, "n": "{big} count", "skip": 1}}'),
        (1, None, {"ts": 2, "mixed": [2, 2.5, "3,5 ms", []], "r/0": "12,5", "s": "1.5e1 s"}),
        (1, None, {"ts": 3, "mixed": 1, "r/0": "12.25 volts", "s": "1,234,567", "w/io:buckets": []}),
        (2, 1, f'{{"skip": 1, "n": "{big} count", "mixed": 1, "w/io:buckets": [7, null, {big}], "ts": 1}}'),  # again, in another order
        (2, 2, {"ts": "4", "n": 5}),  # only in the second delivery
        (2, 3, {"ts": 5e18, "n": 6}),
        (2, 4, {"ts": "soon", "n": 7}),
        (3, 1, {"ts": 6, "v": "3 volts", "state": "open", "ok": True}),
        (3, 2, {"ts": 7, "v": "4 mV"}),
        (4, 1, {"n": 8}),
        (5, 1, {"n": 8}),
        (9, 1, {"ts": 1, "n": 9}),
    ]
    got = [(r["file_id"], r["timestamp_ns"], r["__name__"], r["labels"], r["value"], r["exact"], r["text"]) for r in long_table(*tables(spark, files, records)).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, 1, "w", '{"bucket": "0", "op": "io"}', 7.0, 7, None), (1, 1, "w", '{"bucket": "2", "op": "io"}', float(big), big, None), (1, 1, "n", "{}", float(big), big, f"{big} count"),
            (1, 1, "mixed", "{}", 1.0, None, None), (1, 2, "mixed", '{"bucket": "0"}', 2.0, None, None), (1, 2, "mixed", '{"bucket": "1"}', 2.5, None, None),
            (1, 2, "mixed", '{"bucket": "2"}', 3.5, None, "3,5 ms"), (1, 2, "mixed", '{"bucket": "3"}', None, None, "[]"), (1, 3, "mixed", "{}", 1.0, None, None),
            (1, 2, "r", '{"op": "0"}', 12.5, None, "12,5"), (1, 3, "r", '{"op": "0"}', 12.25, None, "12.25 volts"), (1, 2, "s", "{}", 15.0, None, "1.5e1 s"), (1, 3, "s", "{}", None, None, "1,234,567"),
            (2, 1, "skip", "{}", 1.0, 1, None), (2, 4, "n", "{}", 5.0, 5, None), (2, 5 * 10**18, "n", "{}", 6.0, 6, None), (2, None, "n", "{}", 7.0, 7, None),
            (3, 6, "v", "{}", 3.0, 3, "3 volts"), (3, 7, "v", "{}", None, None, "4 mV"), (3, 6, "state", "{}", None, None, "open"), (3, 6, "ok", "{}", None, None, "true"),
            (4, None, "n", "{}", 8.0, 8, None), (5, None, "n", "{}", 8.0, 8, None),
        ],
        key=str,
    )
    assert _identity("x/1", '{"metric": "m", "bucket": "b", "a": "1", "z": "2"}')[1:] == ('{"a": "1", "bucket": "b", "z": "2"}', '{"a": "1", "bucket": "b", "bucket_": "', '", "z": "2"}')


def test_empty(drifting):
    files, records = drifting
    assert schema_changes(files.limit(0), records).count() == 0 and schema_changes(files, records.limit(0)).where("change_kind NOT LIKE 'label%'").count() == 0
    assert long_table(files.limit(0), records.limit(0)).count() == 0
