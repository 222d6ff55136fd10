from cityweave import session


class Context:
    applicationId = "app-1"  # noqa: N815

    def __init__(self, master):
        self.folder, self.master = None, master

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


class Session:
    def __init__(self, folder, master="local[2]"):
        self.sparkContext = Context(master)
        self.conf = {"spark.sql.warehouse.dir": "hdfs://w/house/"} | ({"spark.checkpoint.dir": folder} if folder else {})


def test_the_clusters_folder_is_used_and_one_is_made_only_where_it_is_unset():
    assert session.shared_folder(Session("hdfs://x/y/")) == "hdfs://x/y"
    s = Session(None)
    folder = session.shared_folder(s)
    assert folder.startswith("file:///") and s.sparkContext.folder == folder and session.shared_folder(s) == folder
    cluster = Session(None, "spark://host:7077")  # executors there don't share the driver's folders
    assert session.shared_folder(cluster) == "hdfs://w/house/_cityweave-app-1" == cluster.sparkContext.folder


def test_checkpointed(spark):
    df = session.checkpointed(spark.range(10))
    assert df.count() == 10
