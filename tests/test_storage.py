import pytest

from popatlas.plans import storage


class Named:
    """A session double: its configuration, master and checkpoint folder."""

    def __init__(self, conf=None, master="yarn", context_dir=None):
        self.conf = conf or {}
        self.sparkContext = self
        self.master, self.context_dir = master, context_dir
        self.applicationId = f"app-{id(self)}"

    def getCheckpointDir(self):
        return self.context_dir


def test_the_named_folder_is_used():
    session = Named({"spark.checkpoint.dir": "hdfs://shared/x/"})
    assert storage.shared_folder(session) == "hdfs://shared/x"
    assert storage.new_folder(session, "t").startswith("hdfs://shared/x/popatlas/t-")
    assert storage.shared_folder(Named(context_dir="hdfs://other")) == "hdfs://other"


def test_no_machine_local_folder_on_a_cluster():
    assert storage.shared_folder(Named()) is None
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.new_folder(Named(), "t")
    assert storage.shared_folder(Named(master="local[2]")).startswith("/")


def test_stored_table_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id, id + 1) AS path")
    kept = storage.stored(df, "t")
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())


def test_without_a_folder_nothing_is_stored(spark, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: None)
    df = spark.range(3)
    assert storage.stored(df, "t") is df
