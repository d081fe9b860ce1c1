"""Versioned tables: parts are replaced alone, a write that stops halfway changes nothing."""

from __future__ import annotations

import pytest

from churnlens.plans.build import SOURCES, _write
from churnlens.sources.snapshots import Snapshots


def rows(table) -> list[tuple]:
    return sorted(tuple(r) for r in table.read().select("id", "source").collect())


def part(spark, source: str, *ids: int):
    return spark.createDataFrame([(i, source) for i in ids], "id int, source string")


def test_parts_are_replaced_alone(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace_part(part(spark, "rule", 1, 2), "rule")
    table.replace_part(part(spark, "llm", 7), "llm")
    folder = table.parts()["llm"]
    table.replace_part(part(spark, "rule", 3), "rule")
    assert rows(table) == [(3, "rule"), (7, "llm")] and table.parts()["llm"] == folder
    table.replace_part(part(spark, "rule"), "rule")  # a part may become empty
    assert rows(table) == [(7, "llm")]


def test_a_write_that_stops_before_the_switch_leaves_the_table(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.replace(part(spark, "rule", 1))
    table.write_part(part(spark, "rule", 2), "all")  # killed here
    bad = part(spark, "rule", 1).selectExpr("id", "cast(raise_error('stop') as string) as source")
    with pytest.raises(Exception, match="stop"):
        table.replace(bad)
    assert rows(table) == [(1, "rule")]
    table.vacuum()
    assert rows(table) == [(1, "rule")] and len(table.numbers()) == 1


def test_two_writers_of_one_number(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.replace(part(spark, "rule", 1))
    mine, theirs = table.write_part(part(spark, "rule", 2), "all"), table.write_part(part(spark, "rule", 3), "all")
    table.switch({"all": theirs}, 1)
    with pytest.raises(RuntimeError, match="another writer"):
        table.switch({"all": mine}, 1)
    assert rows(table) == [(3, "rule")]


def test_a_reader_of_an_old_state_goes_on(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"))
    table.replace(part(spark, "rule", 1))
    old = table.read()
    table.replace(part(spark, "rule", 2))
    assert [r.id for r in old.collect()] == [1] and rows(table) == [(2, "rule")]
    table.vacuum(keep=2)
    assert [r.id for r in old.collect()] == [1]


def test_the_build_keeps_rows_of_other_sources(spark, fx, tmp_path):
    path = str(tmp_path)
    themes = fx.aggregate_theme
    _write(themes, path, "aggregate_theme")
    table = Snapshots(spark, f"{path}/aggregate_theme")
    assert set(table.parts()) == set(SOURCES["aggregate_theme"])
    own = themes.limit(1).selectExpr(*[c if c != "source" else "'manual' as source" for c in themes.columns])
    table.replace_part(own, "manual")
    _write(themes, path, "aggregate_theme")
    assert table.read().where("source = 'manual'").count() == 1
    assert table.read().where("source = 'rule'").count() == themes.where("source = 'rule'").count()
