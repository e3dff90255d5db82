"""Schemas that drift between files: a catalogue of column lifespans, a report of changes, one long table.

1. Catalogue.  Payloads and headers are exploded to one row per file and field (an aggregation on file and
   field): the types of its values, its first and last value, its metadata.
2. Lifespans.  Files of a producer are numbered in order; per producer and field, ``lag`` over that
   number finds the islands of presence, their starts and endings.
3. Renames.  The fields that end and those that start at the same file are matched one to one: by identity (metadata), by names
   equal but for separators and case, by names of which one has all letters of the other in their order (affixes,
   abbreviations) and whose values do not contradict, and by values alone, where they carry on within what the series move.
   The files, the catalogue and the renames are settled in the shared folder: what follows reads them several times.
4. Types are compared along a lifespan, across a rename with the lifespan before; fields that are only null keep
   their type.  Labels are compared per metric between headers.
5. The renames form an alias table, with the cast that fits all types of a series; all records are read with it into one table
   in the long schema: numbers, texts that hold one, and the elements of lists, each list element as a series of its own.

Scale: records are reduced to the catalogue before anything is sorted; a producer with a third of all
records is spread by file and field.  What is matched in Python is only the columns of two successive files.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import settle
from gridloom.sources.wide import RESERVED_KEYS, parse_column

_HEADER = "array<struct<name: string, type: string, metadata: map<string, string>>>"
#: A new field's first value carries on an old one's last if they differ by less than this share, and, where the names
#: don't agree, by no more than so many times what either moves within a file.
CARRY_ON, MOVES = 0.25, 2.0
#: A text that holds a number (1), with a decimal point or comma, and perhaps a unit (2).
_NUMBER = r"^\s*([-+]?\d*[.,]?\d+(?:[eE][-+]?\d+)?)\s*([\p{L}%°][^\s\d,;:]*)?\s*$"


def _ignored() -> Column:
    return F.coalesce(F.array_compact("ignore_columns"), F.array().cast("array<string>"))


def _number(text: Column) -> Column:
    """The number that a text holds, as double."""
    return F.coalesce(text.try_cast("double"), F.replace(F.regexp_extract(text, _NUMBER, 1), F.lit(","), F.lit(".")).try_cast("double"))


def _broken(text: Column) -> Column:
    """Whether a text holds a number that isn't written as a whole one."""
    return F.when(_number(text).isNotNull(), ~F.regexp_extract(text, _NUMBER, 1).rlike(r"^[-+]?\d+$")).otherwise(False)


def numbered_files(files: DataFrame) -> DataFrame:
    """The files with their number ``n`` (1, 2, ...) within their agent, ordered by written_at, then file_id."""
    over = Window.partitionBy("agent").orderBy(F.col("written_at").asc_nulls_first(), "file_id")
    kept = files.where(F.col("file_id").isNotNull())
    return kept.select("file_id", "agent", "timestamp_column", _ignored().alias("ignored"), F.from_json("header", _HEADER).alias("header"), F.row_number().over(over).alias("n"))


def payload_fields(records: DataFrame, **more: Column) -> DataFrame:
    """One row per record and field: file_id, record_id, line_no, field, kind (whole, decimal, text, list or null), number, text.

    Payloads that are null or no JSON objects have no fields.  ``more`` are further columns, of the record and its parsed payload ``p``.
    """
    parsed = records.withColumn("p", F.try_parse_json("payload")).where(F.col("p").isNotNull())
    parsed = parsed.select("file_id", "record_id", "line_no", *[c.alias(n) for n, c in more.items()], "p")
    exploded = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("p").outer()))
    flat = exploded.where(F.col("key").isNotNull()).select("file_id", "record_id", "line_no", *more, F.col("key").alias("field"), F.col("value").alias("v"))
    shape = F.schema_of_variant("v")
    kind = (
        F.when(shape.startswith("ARRAY"), "list")
        .when(shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "whole")
        .when(shape.rlike(r"^DECIMAL\(\d+,\s*0\)$") & ~F.contains(F.expr("CAST(v AS STRING)"), F.lit(".")), "whole")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "decimal")
        .when(shape.isin("VOID", "NULL"), None)
        .otherwise("text")
    )
    text = F.expr("CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN to_json(v) ELSE CAST(v AS STRING) END")
    return flat.select("file_id", "record_id", "line_no", *more, "field", kind.alias("kind"), F.expr("try_cast(CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN NULL ELSE CAST(v AS STRING) END AS DOUBLE)").alias("number"), text.alias("text"))


def catalogue(numbered: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per file and field: agent, n, file_id, field, type (null if only null), first, last (numbers; of lists their sums), move (greatest less least), broken (whether some numbers are no whole ones), meta, unit."""
    kinds = [F.max(F.col("kind") == k) for k in ("list", "text", "decimal", "whole")]
    kind = F.when(kinds[0], "list").when(kinds[1], "text").when(kinds[2], "decimal").when(kinds[3], "whole")
    listed = F.filter(F.from_json("text", "array<double>"), lambda x: x.isNotNull())
    total = F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda a, x: a + x))
    number = F.when(F.col("kind") == "list", total).otherwise(F.col("number"))
    value = F.when(number.isNotNull(), F.struct("line_no", number.alias("number")))
    broken = F.when(F.col("kind") == "text", _broken(F.col("text"))).when(F.col("kind") == "list", F.exists(F.from_json("text", "array<string>"), _broken)).otherwise(F.col("kind") == "decimal")
    each = fields.groupBy("file_id", "field").agg(kind.alias("type"), F.min(value)["number"].alias("first"), F.max(value)["number"].alias("last"), (F.max(number) - F.min(number)).alias("move"), F.max(broken).alias("broken"))
    told = numbered.select("file_id", F.explode("header").alias("h")).select("file_id", F.col("h.name").alias("field"), F.col("h.metadata").alias("m"))
    told = told.where(F.col("m").isNotNull()).dropDuplicates(["file_id", "field"])
    meta = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("m", lambda k, v: k != "unit")))))
    joined = each.join(numbered.select("file_id", "agent", "n", "timestamp_column", "ignored"), "file_id").join(told.select("file_id", "field", meta.alias("meta"), F.col("m")["unit"].alias("unit")), ["file_id", "field"], "left")
    kept = ~F.col("field").eqNullSafe(F.col("timestamp_column")) & ~F.array_contains("ignored", F.col("field"))
    return joined.where(kept).select("agent", "n", "file_id", "field", "type", "first", "last", "move", "broken", "meta", "unit")


def lifespans(cat: DataFrame) -> DataFrame:
    """The catalogue with ``life`` (number of the first file of the presence island) and ``until`` (that of its last file)."""
    over = Window.partitionBy("agent", "field").orderBy("n")
    start = F.when(F.lag("n").over(over).isNull() | (F.lag("n").over(over) < F.col("n") - 1), F.col("n"))
    marked = cat.withColumn("life", F.last(start, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy("agent", "field", "life").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy("agent", "field", "life")
    return marked.select(
        "*",
        F.max("n").over(island).alias("until"),
        F.last("type", ignorenulls=True).over(so_far).alias("known_type"),
        F.last("last", ignorenulls=True).over(so_far).alias("known_last"),
        F.last("move", ignorenulls=True).over(so_far).alias("known_move"),
        F.last("meta", ignorenulls=True).over(so_far).alias("known_meta"),
    )


def plain_name(name: str) -> str:
    """A name without separators and case."""
    return re.sub(r"[^0-9a-z]", "", name.lower())


def _told(meta: str | None) -> tuple | None:
    """Metric and label values, whatever the labels' names."""
    if not meta:
        return None
    m = json.loads(meta)
    return m.get("metric"), *sorted(str(v) for k, v in m.items() if k not in RESERVED_KEYS)


def name_agreement(a: str, b: str) -> int:
    """2 if two plain names are equal, 1 if the longer has all characters of the other in their order (an affix, an abbreviation), else 0."""
    if a == b:
        return 2
    short, rest = (a, iter(b)) if len(a) < len(b) else (b, iter(a))
    return int(len(short) > 1 and all(c in rest for c in short))


def match_renames(ended: list[dict], started: list[dict]) -> list[tuple[str, str]]:
    """Pairs (old, new) of fields that end and start at one file and are the same series; each field is in one pair at most.

    A field has field, type, value (the last or the first one), move and meta.  The sums of lists may change at will where names agree.  Equal metadata, equal metric and label values and equal plain
    names count where they are unambiguous; all other pairs by how well their names agree, then by how close their values are.
    """
    pairs: list[tuple[str, str]] = []
    old = {e["field"]: e for e in ended}
    new = {s["field"]: s for s in started}

    def group(rows: dict[str, dict], key) -> dict:
        out: dict = {}
        for f, r in rows.items():
            if (k := key(f, r)) is not None:
                out.setdefault(k, []).append(f)
        return out

    alike = lambda a, b: (a["type"] == "list") == (b["type"] == "list") or a["type"] is None or b["type"] is None
    for key in (lambda f, r: r["meta"], lambda f, r: _told(r["meta"]), lambda f, r: plain_name(f)):
        a, b = group(old, key), group(new, key)
        for k in a.keys() & b.keys():
            if len(a[k]) == len(b[k]) == 1 and alike(old[a[k][0]], new[b[k][0]]):
                pairs.append((a[k][0], b[k][0]))
        for x, y in pairs:
            old.pop(x, None)
            new.pop(y, None)
    ranked = []
    for x, y in _near(old, new):
        a, b = old[x], new[y]
        if not alike(a, b) or (a["meta"] and b["meta"] and _told(a["meta"])[0] != _told(b["meta"])[0]):
            continue
        names = name_agreement(plain_name(x), plain_name(y))
        if a["value"] is None or b["value"] is None:
            gap, carries = CARRY_ON, False
        else:
            apart = abs(b["value"] - a["value"])
            gap = apart / max(abs(a["value"]), abs(b["value"]), 1e-12)
            if gap >= CARRY_ON and names < 2 and not (names and _is_list(a)):
                continue
            carries = apart <= MOVES * max(a["move"] or 0.0, b["move"] or 0.0)
        if names or carries:
            ranked.append((-names, gap, x, y))
    for _, _, x, y in sorted(ranked):
        if x in old and y in new:
            pairs.append((x, y))
            del old[x], new[y]
    return pairs


def _is_list(field: dict) -> bool:
    return field["type"] == "list"


def _near(old: dict[str, dict], new: dict[str, dict]) -> Iterator[tuple[str, str]]:
    """The pairs whose values are about as close as CARRY_ON wants, those with a list or an unknown value, and those of equal plain names."""
    known = sorted((r["value"], x) for x, r in old.items() if r["value"] is not None and not _is_list(r))
    at = [v for v, _ in known]
    plain: dict[str, list[str]] = {}
    for x in old:
        plain.setdefault(plain_name(x), []).append(x)
    for y, r in new.items():
        if (v := r["value"]) is None or _is_list(r):
            yield from ((x, y) for x in old)
            continue
        ends = sorted((v * (1 - CARRY_ON), v / (1 - CARRY_ON)))
        close = {x for _, x in known[bisect_left(at, ends[0]) : bisect_right(at, ends[1])]}
        close |= {x for x, o in old.items() if o["value"] is None or _is_list(o)} | set(plain.get(plain_name(y), ()))
        yield from ((x, y) for x in sorted(close))


_EVENT = "agent string, n int, change_kind string, old_field string, new_field string"


def _field_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (agent, n, fields that ended, fields that started) to events."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            pairs = match_renames(row["ended"], row["started"])
            gone, come = {a for a, _ in pairs}, {b for _, b in pairs}
            events = [("renamed", a, b) for a, b in pairs]
            events += [("removed", r["field"], "") for r in row["ended"] if r["field"] not in gone]
            events += [("added", "", r["field"]) for r in row["started"] if r["field"] not in come]
            out += [(row["agent"], row["n"], *e) for e in events]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["agent", "n", "change_kind", "old_field", "new_field"])


def field_changes(spans: DataFrame, numbered: DataFrame) -> DataFrame:
    """added, removed and renamed fields: agent, n, change_kind, old_field, new_field."""
    files = numbered.groupBy("agent").agg(F.max("n").alias("files"))
    field = lambda kind, value, move, meta: F.struct("field", F.col(kind).alias("type"), F.col(value).alias("value"), F.col(move).alias("move"), F.col(meta).alias("meta"))
    starts = spans.where((F.col("n") == F.col("life")) & (F.col("n") > 1)).select("agent", "n", F.lit(None).alias("ended"), field("type", "first", "move", "meta").alias("started"))
    ends = spans.where(F.col("n") == F.col("until")).join(files, "agent").where(F.col("until") < F.col("files"))
    ends = ends.select("agent", (F.col("n") + 1).alias("n"), field("known_type", "known_last", "known_move", "known_meta").alias("ended"), F.lit(None).alias("started"))
    # nulls are left out of the lists
    return starts.unionByName(ends).groupBy("agent", "n").agg(F.collect_list("ended").alias("ended"), F.collect_list("started").alias("started")).mapInArrow(_field_changes, _EVENT)


def type_changes(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields whose values' type differs from the one known before, in the lifespan or in the one it was renamed from."""
    renames = changes.where(F.col("change_kind") == "renamed").select("agent", F.col("n").alias("life"), F.col("new_field").alias("field"), F.col("old_field").alias("before"))
    ends = spans.where(F.col("n") == F.col("until")).select("agent", (F.col("n") + 1).alias("life"), F.col("field").alias("before"), F.col("known_type").alias("inherited"))
    over = Window.partitionBy("agent", "field", "life").orderBy("n")
    r = spans.withColumn("previous", F.lag("known_type").over(over)).join(renames.join(ends, ["agent", "life", "before"]), ["agent", "field", "life"], "left")
    previous = F.coalesce("previous", "inherited")
    old = F.when(F.col("n") == F.col("life"), F.col("before")).otherwise(F.col("field"))
    return r.where(F.col("type").isNotNull() & (F.col("type") != previous)).select("agent", "n", F.lit("type_changed").alias("change_kind"), old.alias("old_field"), F.col("field").alias("new_field"))


def _label_changes(frame: pd.DataFrame) -> pd.DataFrame:
    agent, n, metric = frame["agent"].iloc[0], int(frame["n"].iloc[0]), frame["metric"].iloc[0]
    old = {r.label: set(r.old_values) for r in frame.itertuples() if r.old_values is not None}
    new = {r.label: set(r.new_values) for r in frame.itertuples() if r.new_values is not None}
    gone, come = {k: v for k, v in old.items() if k not in new}, {k: v for k, v in new.items() if k not in old}
    ranked = sorted(((-len(a & b) / len(a | b), x, y) for x, a in gone.items() for y, b in come.items() if a and len(a & b) * 2 >= len(a | b)))
    out, mark = [], lambda label: f"{metric}{{{label}}}"
    for _, x, y in ranked:
        if x in gone and y in come:
            out.append(("label_renamed", mark(x), mark(y)))
            del gone[x], come[y]
    out += [("label_removed", mark(x), "") for x in gone] + [("label_added", "", mark(y)) for y in come]
    return pd.DataFrame([(agent, n, *x) for x in out], columns=["agent", "n", "change_kind", "old_field", "new_field"])


def label_changes(numbered: DataFrame) -> DataFrame:
    """Labels added, removed or renamed per metric, between each header with metadata and the one before it."""
    told = numbered.where(F.exists("header", lambda h: h["metadata"].isNotNull()))
    told = told.withColumn("h", F.row_number().over(Window.partitionBy("agent").orderBy("n")))
    flat = told.select("agent", "n", "h", "timestamp_column", "ignored", F.explode("header").alias("f"))
    flat = flat.where(F.col("f.metadata").isNotNull() & ~F.col("f.name").eqNullSafe(F.col("timestamp_column")) & ~F.array_contains("ignored", F.col("f.name")))
    labels = flat.select("agent", "h", F.col("f.metadata")["metric"].alias("metric"), F.explode_outer(F.map_filter("f.metadata", lambda k, v: ~k.isin(*RESERVED_KEYS))).alias("label", "v")).where(F.col("metric").isNotNull())
    values = labels.groupBy("agent", "h", "metric", "label").agg(F.collect_set("v").alias("values"))
    present = values.select("agent", "h", "metric").distinct()
    both = present.join(present.select("agent", (F.col("h") + 1).alias("h"), "metric"), ["agent", "h", "metric"])
    new = values.where(F.col("label").isNotNull()).withColumnRenamed("values", "new_values")
    old = values.where(F.col("label").isNotNull()).select("agent", (F.col("h") + 1).alias("h"), "metric", "label", F.col("values").alias("old_values"))
    changed = new.join(old, ["agent", "h", "metric", "label"], "full").where(F.col("new_values").isNull() | F.col("old_values").isNull())
    changed = changed.join(both, ["agent", "h", "metric"]).join(told.select("agent", "h", "n"), ["agent", "h"])
    return changed.groupBy("agent", "n", "metric").applyInPandas(_label_changes, _EVENT)


def schema_changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """Every change between successive files of an agent: file_id, change_kind, old_field, new_field."""
    numbered = settle(numbered_files(files))  # the headers are parsed once
    spans = settle(lifespans(catalogue(numbered, payload_fields(records))))
    changes = settle(field_changes(spans, numbered))
    events = changes.unionByName(type_changes(spans, changes)).unionByName(label_changes(numbered))
    return events.join(numbered.select("agent", "n", "file_id"), ["agent", "n"]).select("file_id", "change_kind", "old_field", "new_field")


def _origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (agent, the renames of one of its chains of fields) to the name each field had first."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            origin: dict[str, str] = {}
            for r in sorted(row["renames"], key=lambda r: r["n"]):
                origin[r["new_field"]] = origin.get(r["old_field"], r["old_field"])
                out.append((row["agent"], r["new_field"], r["n"], origin[r["new_field"]]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.int32(), pa.string()], strict=True)], names=["agent", "field", "life", "origin"])


def alias_table(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """For each field of each file: agent, file_id, field, origin (its first name), known_meta, unit, and ``cast``, to which all types of the series can be cast.

    ``cast`` is whole if all values and elements of lists that are numbers are whole ones, else decimal.
    """
    renames = changes.where(F.col("change_kind") == "renamed").select("agent", F.struct("n", "old_field", "new_field").alias("r"))
    aliases = renames.groupBy("agent").agg(F.collect_list("r").alias("renames")).mapInArrow(_origins, "agent string, field string, life int, origin string")
    named = spans.join(aliases, ["agent", "field", "life"], "left").withColumn("origin", F.coalesce("origin", "field"))
    cast = F.when(F.max("broken").over(Window.partitionBy("agent", "origin")), "decimal").otherwise("whole")
    return named.select("agent", "file_id", "field", "origin", "known_meta", "unit", cast.alias("cast"))


def _identity(name: str | None, meta: str | None) -> tuple[str | None, str, str, str]:
    """Metric and labels (JSON, sorted) of a field, from its metadata or by the slash convention of its name.

    Then what stands before and after the position in the labels of a list's element: these have a label ``bucket`` too (``bucket_`` if there is one already).
    """
    metric, labels = parse_column(name or "", json.loads(meta) if meta else None)
    bucket = "bucket"
    while bucket in labels:
        bucket += "_"
    dump = lambda wanted: json.dumps({k: labels[k] for k in sorted(labels) if wanted(k)})
    before, after = dump(lambda k: k < bucket)[:-1], dump(lambda k: k > bucket)[1:]
    return metric, dump(lambda k: True), before + ", " * (len(before) > 1) + f'"{bucket}": "', '"' + ", " * (len(after) > 1) + after


def long_table(files: DataFrame, records: DataFrame) -> DataFrame:
    """All records as one table in the long schema.

    Returns agent, file_id, line_no, timestamp_ns, ``__name__``, labels (JSON, sorted keys), value, exact, text.  Renamed fields keep the identity of
    their origin.  Values are read by the cast of the alias table: series of whole numbers as decimal(38,0) (``exact``; null for others) and as the double
    next to it, all others as double.  Each element of a list is a row, with its position (0, 1, ...) as the label ``bucket``.  Texts may have a decimal
    comma and a unit, which is not converted; a unit other than the header's, or a text without a number, leaves ``value`` null.  What is not plainly a number
    stays readable in ``text``.  Only nulls, empty lists and records of unknown files have no rows; ``timestamp_ns`` is null where a record has no valid one.

    A value counts once if it is stored again with the same file path, line and time (for the first file by written_at, arrived_at, file_id).
    """
    numbered = settle(numbered_files(files))  # the headers are parsed once
    spans = settle(lifespans(catalogue(numbered, payload_fields(records))))
    named = alias_table(spans, field_changes(spans, numbered))
    over = Window.partitionBy("agent", "path", F.when(F.col("path").isNull(), F.col("file_id"))).orderBy("written_at", "arrived_at", "file_id")
    placed = files.where(F.col("file_id").isNotNull()).select("file_id", "timestamp_column", _ignored().alias("ignored"), F.first("file_id").over(over).alias("source"), F.row_number().over(over).alias("delivery"))
    stamp = F.expr("try_cast(try_cast(CAST(try_cast(p AS MAP<STRING, VARIANT>)[timestamp_column] AS STRING) AS DECIMAL(38,0)) AS BIGINT)")
    skipped = F.array_compact(F.array_append(F.col("ignored"), F.col("timestamp_column")))
    fields = payload_fields(records.join(placed, "file_id"), source=F.col("source"), delivery=F.col("delivery"), timestamp_ns=stamp, skipped=skipped)
    values = fields.where(F.col("text").isNotNull() & ~F.array_contains("skipped", F.col("field"))).withColumn("listed", F.col("kind") == "list")
    once = values.groupBy("source", "line_no", "timestamp_ns", "field", "text", "listed").agg(F.min("delivery").alias("delivery"))

    @F.pandas_udf("struct<metric: string, labels: string, before: string, after: string>")
    def identity(origin: pd.Series, meta: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_identity(o, m) for o, m in zip(origin, meta, strict=True)], columns=["metric", "labels", "before", "after"])

    known = named.join(placed.select("file_id", "source", "delivery"), "file_id").select("source", "delivery", "agent", "file_id", "field", "cast", "unit", identity("origin", "known_meta").alias("i"))
    items = F.when(F.col("listed"), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    joined = once.join(known, ["source", "delivery", "field"])
    rows = joined.select("agent", "file_id", "line_no", "timestamp_ns", "cast", "unit", "i", "listed", F.posexplode(items).alias("at", "item")).where(F.col("item").isNotNull())
    labels = F.when(F.col("listed"), F.concat("i.before", F.col("at").cast("string"), "i.after")).otherwise(F.col("i.labels"))
    item, plain = F.col("item"), F.col("item").try_cast("double")
    unit = F.regexp_extract("item", _NUMBER, 2)
    value = F.coalesce(plain, F.when((unit == "") | F.coalesce(unit == F.col("unit"), F.lit(True)), _number(item)))
    whole = F.coalesce(item.try_cast("decimal(38,0)"), F.regexp_extract("item", _NUMBER, 1).try_cast("decimal(38,0)"))
    out = rows.select("agent", "file_id", "line_no", "timestamp_ns", F.col("i.metric").alias("__name__"), labels.alias("labels"), value.alias("value"), "cast", whole.alias("whole"), F.when(plain.isNull(), item).alias("text"))
    exact = F.when((F.col("cast") == "whole") & F.col("value").isNotNull(), F.col("whole"))
    return out.select("agent", "file_id", "line_no", "timestamp_ns", "__name__", "labels", "value", exact.alias("exact"), "text")
