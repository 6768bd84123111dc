import pytest

from ionquill import storage


class Session:
    """As much of a session as the folder's choice reads."""

    def __init__(self, master, warehouse, named=None):
        held = {"spark.master": master, "spark.checkpoint.dir": named}
        settings = {"spark.sql.warehouse.dir": warehouse}

        class Conf:
            def get(self, key, default=None):
                return settings.get(key, held.get(key) or default)

            def set(self, key, value):
                settings[key] = value

        self.conf = Conf()
        self.sparkContext = type("Context", (), {"getConf": lambda _: type("C", (), {"get": lambda _, k, d=None: held.get(k, d)})()})()


def test_the_named_folder_comes_first():
    assert storage.shared_dir(Session("spark://a:1", "file:/tmp/w", "hdfs://a/work/")) == "hdfs://a/work"


def test_a_shared_warehouse_serves_where_none_is_named():
    assert storage.shared_dir(Session("spark://a:1", "hdfs://a/w/")) == "hdfs://a/w/_ionquill_work"


@pytest.mark.parametrize("warehouse", ["file:/tmp/w", "file:///tmp/w", "/tmp/w", "w"])
def test_a_machine_s_own_folder_is_refused_on_a_cluster(warehouse):
    with pytest.raises(ValueError):
        storage.shared_dir(Session("spark://a:1", warehouse))
    assert storage.shared_dir(Session("local[2]", warehouse)).startswith("file://")
