"""CSV records over several lines against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from wireloom.functions import fixed_values as fixed
from wireloom.operators import lookups
from wireloom.sources import csv_records, router
from wireloom.sources.delimited import csv_cells

SCHEMA = "organization_id long, batch_id string, block long, line_id long, value string"


def frame(spark, files, block=3):
    """Lines of files, dealt to blocks of a few lines each."""
    rows = [(1, name, i // block * block, i % block, v) for name, text in files.items() for i, v in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def cells_of(records):
    found = records.withColumn("cells", csv_cells(F.col("value"))).orderBy("batch_id", "block", "line_id").collect()
    out = {}
    for r in found:
        if r.value != "":
            out.setdefault(r.batch_id, []).append(list(r.cells))
    return out


def wanted(files):
    return {n: rows for n, t in files.items() if (rows := [r for r in csv.reader(io.StringIO(t)) if r])}


def test_random_texts_equal_the_csv_module(spark):
    rng = random.Random(4)
    pieces = ['"', '""', ",", "\n", "a", "b c", '"x', 'y"', '","', "é", "\n\n", '"\n', '\n"']
    files = {f"f{i:03d}": "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for i in range(250)}
    for block in (1, 3, 1000):
        assert cells_of(csv_records.csv_records(frame(spark, files, block))) == wanted(files)


def test_files_without_open_quotes_stay_as_they_are(spark):
    lines = frame(spark, {"a": 'x,"y"\n1,"2, ""3"""', "b": 'k"ept,li"teral\n"closed" then'})
    assert csv_records.csv_records(lines) is lines
    assert csv_records.csv_records(lines.limit(0)).count() == 0


def test_long_cells_reject_the_file(spark, monkeypatch):
    monkeypatch.setattr(fixed, "CSV_CELL_LIMIT", 50)
    fits, over = "z" * 24, "z" * 27
    files = {
        "single-fits": "a,b\n" + "x" * 50 + ",1", "single-over": "a,b\n" + "x" * 51 + ",1",
        "two-lines-fit": f'a,b\n"{fits}\n{fits}",1', "two-lines-over": f'a,b\n"{over}\n{over}",1',
        "swallowed": 'a,b\n"open\n' + "\n".join(["never closed"] * 40), "many-cells": "a,b\n" + ",".join(f'"{fits}\n{fits}"' for _ in range(6)),
        "plain": "a,b\n1,2",
    }
    got = cells_of(csv_records.csv_records(frame(spark, files)))
    assert set(got) == {"single-fits", "two-lines-fit", "many-cells", "plain"}
    assert got == {n: r for n, r in wanted(files).items() if n in got}


HEADER = 'src,dst,"ev\nent",hostname'


def test_events_with_quoted_line_ends(spark):
    files = {
        "a": 'src,dst,event,hostname\n1,2,"scan\n9,9,inner,x\n\nend",d.com\n3,4,bot,"e.com\n"\n,5,no source,',
        "b": "src,dst,event\n1,2,plain",
        "c": 'note,src,dst,event\n"kept\nopen",1,2,x\n"a ""quoted"", cell\n",5,6,y\n,7,8,"unclosed\nrest',
    }
    events = router.normalize_csv(frame(spark, files, 2)).orderBy("batch_id", "block", "line_id").collect()
    assert [(r.batch_id, r.source_ip, r.alert_type, r.domain) for r in events] == [
        ("a", "1", "scan\n9,9,inner,x\n\nend", "d.com"), ("a", "3", "bot", "e.com\n"), ("b", "1", "plain", ""),
        ("c", "1", "x", ""), ("c", "5", "y", ""), ("c", "7", "unclosed\nrest", ""),
    ]


def test_header_over_two_lines(spark):
    files = {"h": '"timestamp","src","the\nnote",dst,event\nt1,1,"a\nb",2,e', "j": '{"src": "1", "dst": "2"}\n{"src": "1", "dst": "2"}'}
    for events in (router.normalize_csv(frame(spark, {"h": files["h"]})), router.parse_logs(frame(spark, files))):
        found = [tuple(r) for r in events.filter("batch_id = 'h'").select("timestamp", "source_ip", "destination_ip", "alert_type").collect()]
        assert found == [("t1", "1", "2", "e")]
    routes = {r.batch_id: r.route for r in router.choose_routes(frame(spark, files)).collect()}
    assert routes == {"h": "csv", "j": "json"}


@pytest.mark.parametrize("rows", [0, 10_000])
def test_lines_are_never_the_broadcast_side(spark, monkeypatch, rows):
    """One row per file goes to the lines; if there are too many, the join moves both but broadcasts neither."""
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", rows)
    files = {f"f{i}": "src,dst,event\n" + "\n".join(f"1,2,e{i}-{j}" for j in range(30)) for i in range(5)}
    events = router.normalize_csv(frame(spark, files, 7))
    assert events.count() == 150
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (rows > 0) and ("Join LeftOuter" in plan or "Join Inner" in plan)
    physical = events._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in physical
