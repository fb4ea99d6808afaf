from types import SimpleNamespace

import pytest

from tidemark.session import shared_dir


class Conf(dict):
    def get(self, name, default=None):
        return super().get(name, default)


def session(master, warehouse, checkpoint=None):
    conf = Conf({"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": checkpoint})
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder():
    assert shared_dir(session("yarn", "file:/x", "hdfs://a/b/")) == "hdfs://a/b"
    assert shared_dir(session("local[4]", "file:/x/w")) == "file:/x/w/_tidemark_work"
    assert shared_dir(session("yarn", "hdfs://n/w/")) == "hdfs://n/w/_tidemark_work"
    for warehouse in ("file:/x/w", "/x/w"):
        with pytest.raises(ValueError):
            shared_dir(session("yarn", warehouse))
