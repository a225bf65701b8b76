"""The working folder."""

import os
from types import SimpleNamespace

from stackroom.session import new_run_dir, remove_run_dirs, work_dir


def settings(**given):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: given.get(key.replace(".", "_"), default)))


def test_the_setting_names_the_folder_whatever_the_master():
    both = {"spark_checkpoint_dir": "hdfs://shared/work/", "spark_sql_warehouse_dir": "hdfs://shared/tables"}
    assert work_dir(settings(**both)) == "hdfs://shared/work/stackroom"
    assert work_dir(settings(spark_sql_warehouse_dir="file:/tables")) == "file:/tables/stackroom"


def test_folders_of_runs_are_fresh_and_can_be_removed(spark):
    first, second = new_run_dir(spark, "rows"), new_run_dir(spark, "rows")
    assert first != second and first.startswith(work_dir(spark))
    other = new_run_dir(spark.newSession(), "rows")
    for path in (first, other):
        spark.range(1).write.parquet(path)
    assert os.path.isdir(first)
    kept = dict.fromkeys([first, other])
    remove_run_dirs(spark)
    assert not any(os.path.isdir(path) for path in kept)
