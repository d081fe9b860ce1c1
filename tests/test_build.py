"""The build path: serving from the materialised warehouse gives the same rows
as deriving every query from the raw tables."""

from churnlens.plans.build import build_warehouse
from churnlens.plans.present import present
from churnlens.plans.registry import run
from churnlens.sources.tables import WAREHOUSE_CONF, WAREHOUSE_SOURCE_CONF

SF = "/root/testdata/sf0.001"
NAMES = ["customer_features", "segment_metrics", "quality_report", "rank_customer_risk", "retrieve_sources",
         "eval_summary", "guard_output_eval", "classify_intent"]


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_warehouse_matches_raw(spark):
    before = {n: _rows(present(run(n, spark, SF))) for n in NAMES}
    build_warehouse(spark, SF)
    try:
        after = {n: _rows(present(run(n, spark, SF))) for n in NAMES}
    finally:
        spark.conf.unset(WAREHOUSE_CONF)
        spark.conf.unset(WAREHOUSE_SOURCE_CONF)
    assert before == after


def test_a_changed_source_is_not_served_from_an_old_warehouse(spark, tmp_path):
    import os
    import shutil

    from churnlens.sources.tables import source_mark, warehouse_for
    copy = str(tmp_path / "sf")
    shutil.copytree(SF, copy)
    os.chmod(copy, 0o755)  # the test data folder is read-only, and its mode is copied
    spark.conf.set(WAREHOUSE_CONF, "/somewhere")
    spark.conf.set(WAREHOUSE_SOURCE_CONF, source_mark(spark, copy))
    try:
        assert warehouse_for(spark, copy + "/") == "/somewhere" and warehouse_for(spark, SF) is None
        spark.range(1).write.parquet(f"{copy}/more.parquet")
        assert warehouse_for(spark, copy) is None
    finally:
        spark.conf.unset(WAREHOUSE_CONF)
        spark.conf.unset(WAREHOUSE_SOURCE_CONF)


def test_a_replaced_file_inside_a_table_is_noticed(spark, tmp_path):
    from churnlens.sources.tables import source_mark
    table = tmp_path / "documents.parquet"
    spark.range(10).write.parquet(str(table))
    first = source_mark(spark, str(tmp_path))
    assert source_mark(spark, str(tmp_path) + "/") == first
    spark.range(10).write.mode("append").parquet(str(table))
    assert source_mark(spark, str(tmp_path)) != first
