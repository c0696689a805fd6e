"""Decks, fill, results and changed tiles as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from lithoscan.operators import derived, fill
from lithoscan.plans import deck as decks
from lithoscan.plans import stage
from lithoscan.streaming import tiles

BOX = "id long, layer int, x0 long, y0 long, x1 long, y1 long"


def boxes(spark, *rows, layer=1, first=0):
    return spark.createDataFrame([(first + i, layer, *r) for i, r in enumerate(rows)], BOX)


def test_scalars_have_dimensions():
    d = decks.Deck((), {"gap": {"value": 0.1, "unit": "um"}, "area": {"op": "mul", "args": [{"var": "gap"}, {"var": "gap"}]}, "loop": {"var": "loop"}})
    assert d.value({"var": "gap"}) == 100 and d.value({"var": "area"}) == 10_000
    assert d.value({"op": "add", "args": [{"var": "gap"}, 5, {"value": 2, "unit": "nm"}]}) == 107
    assert d.quantity({"op": "div", "args": [{"var": "area"}, {"var": "gap"}]}).power == 1
    for bad in ({"op": "add", "args": [{"var": "gap"}, {"var": "area"}]}, {"var": "loop"}, {"value": 1, "unit": "furlong"}, {"op": "pow", "args": [1, 2]}, {"var": "none"}):
        with pytest.raises((ValueError, KeyError)):
            d.value(bad)


def test_checked_runs_have_a_status_for_every_rule(spark):
    text = json.dumps({"rules": [
        {"kind": "min_width", "id": "w", "layer": "m1", "min": 90}, {"kind": "notch", "id": "n", "layer": "m1", "min": 10}, {"kind": "off_grid", "id": "g", "layer": "m1", "grid": 5},
        {"kind": "antenna", "id": "a", "metal": 1, "ratio": 2}, {"kind": "cut_class", "id": "c", "layer": "m1", "classes": [[80, 400], [200, 200]]},
        {"kind": "min_width", "id": "far", "layer": "m1", "min": 90, "when": {"region": [5000, 5000, 6000, 6000]}}, {"kind": "min_width", "id": "slow", "layer": "m1", "min": 90, "when": {"corner": "slow"}},
        {"kind": "min_width", "id": "volts", "layer": "m1", "min": 90, "when": {"min_volts": 3}}, {"kind": "min_spacing", "id": "s", "layer": "m2", "min": 90},
    ]})
    layers = {"m1": boxes(spark, (0, 0, 80, 400), (1000, 0, 1200, 200))}
    found, statuses = decks.run_checked(spark, decks.Deck.from_json(text), layers)
    got = {r["rule_id"]: r["status"] for r in statuses.collect()}
    assert got == {"w": "Violations", "n": "Clean", "g": "Clean", "a": "NotRun", "c": "Clean", "far": "Clean", "slow": "NotRun", "volts": "Error", "s": "NotRun"}
    assert [(r["rule_id"], r["measured"]) for r in found.collect()] == [("w", 80)] and not decks.is_clean(statuses)
    for bad in ('{"rules": [{"kind": "magic"}]}', '{"rules": [{"kind": "min_width", "layer": "m1"}]}', '{"rules": [{"kind": "min_width", "layer": "m1", "min": 1, "most": 2}]}'):
        with pytest.raises(ValueError):
            decks.Deck.from_json(bad)


def test_rings_beyond_the_arithmetic_end_a_run(spark):
    ring = [{"x": 0, "y": 0}, {"x": 1 << 31, "y": 0}, {"x": 0, "y": 9}]
    rings = spark.createDataFrame([(1, 1, ring)], "id long, layer int, ring array<struct<x:long,y:long>>")
    one = decks.Deck.from_json('{"rules": [{"kind": "min_width", "layer": "m1", "min": 90}]}')
    found, statuses = decks.run_checked(spark, one, {}, decks.Context(rings={"m1": rings}))
    assert [r["kind"] for r in found.collect()] == ["geometry_capacity"] and [r["status"] for r in statuses.collect()] == ["Error"]


def test_fill_meets_the_density(spark):
    rects = boxes(spark, (0, 0, 400, 400), (1200, 100, 1900, 900))
    fills, windows = fill.fill(rects, (0, 0, 2000, 1000), 1000, 0.3, 0.6, 100, 150, 50)
    got = {(r["wx"], r["wy"]): (r["before"], r["after"], r["status"]) for r in windows.collect()}
    assert got == {(0, 0): (160_000, 300_000, "Converged"), (1, 0): (560_000, 560_000, "Converged")}
    for r in fills.collect():
        for x0, y0, x1, y1 in ((0, 0, 400, 400), (1200, 100, 1900, 900)):
            gx, gy = max(r["x0"] - x1, x0 - r["x1"], 0), max(r["y0"] - y1, y0 - r["y1"], 0)
            assert gx * gx + gy * gy >= 2500
    _, blocked = fill.fill(rects, (0, 0, 2000, 1000), 1000, 0.3, 0.6, 100, 150, 50, keepout=boxes(spark, (0, 0, 1000, 1000)))
    assert {r["status"] for r in blocked.where("wx = 0").collect()} == {"Infeasible"}
    assert fill.fill_candidates((0, 0, 300, 300), 1000, 50, 100, "chequerboard", spark).count() == 5
    region = spark.createDataFrame([(1, 0, 0, 2000, 1000)], "id long, x0 long, y0 long, x1 long, y1 long")
    low = fill.scoped_density(rects, region, None, 1000, 500, 0.5)
    assert sorted((r["measured"], r["x"]) for r in low.collect()) == [(160_000, 0), (240_000, 500)]


def test_component_count(spark):
    region = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 10, 0, 20, 10), (1, 20, 10, 30, 20), (2, 0, 0, 5, 5)], "grp long, x0 long, y0 long, x1 long, y1 long")
    assert {r["grp"]: r["components"] for r in derived.component_count(region).collect()} == {1: 2, 2: 1}


def test_changed_tiles_settle_and_are_rechecked(spark, tmp_path):
    rows = [(1_700_000_000 + 60 * k, "m1", k % 3, 0) for k in range(12)]
    spark.createDataFrame(rows, "t long, layer string, tx long, ty long").select(F.timestamp_seconds("t").alias("ts"), "layer", "tx", "ty").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, layer string, tx long, ty long").parquet(str(tmp_path / "in"))
    q = tiles.recheck(stream, lambda t: t.withColumn("checked", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r["tx"], r["checked"]) for r in spark.read.parquet(str(tmp_path / "out/batch=0")).collect()} == {(0, True), (1, True), (2, True)}
    counts = tiles.settled_tiles(stream).writeStream.format("memory").queryName("settled").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("settled").agg(F.sum("n")).first()[0] == 12


def test_staged_tables_are_swept(spark):
    a, b = stage.staged(spark.range(3).toDF("x"), "a"), stage.staged(spark.range(4).toDF("x"), "b")
    stage.sweep(spark, b)
    assert b.count() == 4
    with pytest.raises(Exception, match="(?i)not exist|no such|FILE"):
        spark.read.parquet(a.inputFiles()[0] if a.inputFiles() else "missing").count()
    stage.discard(b)
