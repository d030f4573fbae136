import pytest
from pyspark.sql import functions as F

from pairloom import storage


class Session:
    """Stands in for a session whose folder and master are given."""

    def __init__(self, master, folder=None, conf=None):
        self.sparkContext = self
        self.master, self.folder = master, folder
        self.conf = {"spark.checkpoint.dir": conf} if conf else {}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_named_folder_is_used():
    assert storage.shared_dir(Session("spark://x", conf="hdfs://x/c/")) == "hdfs://x/c"
    assert storage.shared_dir(Session("spark://x", folder="hdfs://x/d")) == "hdfs://x/d"


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError):
        storage.shared_dir(Session("spark://x"))
    assert "pairloom" in storage.shared_dir(Session("local[2]"))


def test_paths_do_not_repeat(spark):
    assert storage.new_path(spark, "x") != storage.new_path(spark, "x")


def test_durable_cuts_the_plan(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = storage.durable(df)
    assert sorted(kept.collect()) == sorted(kept.collect())
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()
