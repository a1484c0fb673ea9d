from pyrewatch import session


class FakeContext:
    applicationId = "app-test"

    def __init__(self, master):
        self.master = master

    def getConf(self):
        return {}


class FakeSession:
    def __init__(self, master, folder=None):
        self.sparkContext = FakeContext(master)
        self.conf = {"spark.checkpoint.dir": folder}


def test_the_named_folder_is_used():
    assert session.shared_folder(FakeSession("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"


def test_a_cluster_without_folder_is_refused():
    try:
        session.shared_folder(FakeSession("spark://host:7077"))
    except RuntimeError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError("no error")


def test_local_mode_gets_one_scratch_folder():
    assert session.shared_folder(FakeSession("local[2]")) == session.shared_folder(FakeSession("local[2]"))


def test_cut_lineage_keeps_rows_and_schema(spark):
    table = spark.sql("SELECT 1 AS a, array('x') AS b, timestamp_ntz'2026-01-01 00:00:00' AS c, map('k', 1.5D) AS d")
    again = session.cut_lineage(table)
    assert again.schema.simpleString() == table.schema.simpleString()
    assert again.collect() == table.collect()
    assert session.cut_lineage(table.where("a > 1")).count() == 0
