"""The shared folder for intermediate tables."""

import os

from sonarium.session import clear_shared, settle, shared_dir


def test_shared_folders_are_cleared(spark):
    clear_shared(spark)
    paths = [shared_dir(spark, "part") for _ in range(2)]
    assert len(set(paths)) == 2
    spark.range(3).write.parquet(paths[0])
    assert os.path.isdir(paths[0])
    assert clear_shared(spark) == 2 and not os.path.exists(paths[0]) and clear_shared(spark) == 0


def test_settling_goes_on_after_clearing(spark):
    for _ in range(2):
        assert settle(spark.range(3)).count() == 3
        clear_shared(spark)
