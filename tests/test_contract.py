import os

import pytest

import __spark_entry__ as driver
from otindex import session

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
def test_entry_runs(spark):
    out = driver.entry(spark)
    assert out.columns == ["period_start", "index"] and out.count() > 0


def test_checkpoints_go_to_the_configured_folder(spark):
    assert session.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.working_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
