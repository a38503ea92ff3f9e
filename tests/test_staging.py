"""Where tables are staged, and that a scope leaves nothing behind."""

from pathlib import Path

import pytest

from scorekit.staging import drop_path, materialize, new_path, path_exists, shared_root, staging_scope


def test_a_scope_removes_what_was_staged_in_it(spark):
    outside = new_path(spark, "outside")
    spark.range(3).write.parquet(outside)
    with staging_scope(spark):
        inside = new_path(spark, "inside")
        materialize(spark.range(5))
        spark.range(5).write.parquet(inside)
        gone = new_path(spark, "gone")
        spark.range(1).write.parquet(gone)
        assert drop_path(spark, gone)
        before = {p.name for p in Path(shared_root(spark).removeprefix("file:")).iterdir()}
    after = {p.name for p in Path(shared_root(spark).removeprefix("file:")).iterdir()}
    assert len(before - after) == 2 and not path_exists(spark, inside)
    assert path_exists(spark, outside) and drop_path(spark, outside)


def test_no_machine_local_folder():
    root = Path(__file__).resolve().parent.parent
    for source in (root / "scorekit").rglob("*.py"):
        assert "tempfile" not in source.read_text(), source


class Elsewhere:
    """A session of a cluster whose warehouse is on a local disk."""

    def __init__(self, spark):
        self.spark, self.conf, self.sparkContext = spark, self, self
        self._jvm, self._jsc, self.master = spark.sparkContext._jvm, spark.sparkContext._jsc, "spark://host:7077"

    def get(self, key, default=None):
        return "file:/data/warehouse" if key == "spark.sql.warehouse.dir" else default

    def getCheckpointDir(self):
        return None


def test_a_local_warehouse_is_refused_on_a_cluster(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Elsewhere(spark))
