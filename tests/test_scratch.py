"""The shared folder comes from the session; a cluster session without one is refused."""

from __future__ import annotations

import pytest

from tricklens.sources.scratch import fresh_path, shared_dir


class _Empty:
    def isPresent(self):
        return False


class _Conf:
    def __init__(self, values=None):
        self.values = values or {}

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Jsc:
    def getCheckpointDir(self):
        return _Empty()


class _Context:
    def __init__(self, master):
        self.master = master
        self._jsc = _Jsc()

    def getConf(self):
        return _Conf()


class _Session:
    def __init__(self, master, conf=None):
        self.sparkContext = _Context(master)
        self.conf = _Conf(conf)


def test_cluster_session_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        shared_dir(_Session("yarn"))


def test_configured_checkpoint_dir_is_used():
    spark = _Session("yarn", {"spark.checkpoint.dir": "s3a://bucket/ckpt/"})
    assert shared_dir(spark) == "s3a://bucket/ckpt"
    assert fresh_path(spark, "x").startswith("s3a://bucket/ckpt/x-")


def test_local_session_gets_a_folder(spark):
    assert shared_dir(spark)
