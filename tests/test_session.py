import os

from starloom import session


def test_scratch_lies_in_the_shared_folder_and_can_be_dropped(spark):
    shared = session.shared_dir(spark)
    assert shared == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    kept = session.barrier(spark.range(3), "kept")
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2]
    path = session.scratch_path(spark, "x")
    assert path.startswith(shared) and path != session.scratch_path(spark, "x")
    root = os.path.dirname(path)
    assert os.path.isdir(root) and spark.sparkContext.applicationId in root
    assert session.drop_scratch(spark) and not os.path.exists(root)


def test_settings_are_applied(spark):
    session.tune(spark)
    assert all(spark.conf.get(k) == v for k, v in session.RUNTIME_SETTINGS.items())
