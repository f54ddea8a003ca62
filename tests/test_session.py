"""The shared folder is read from the session; only the context is set when it is missing."""

import pytest

from chatprep.session import checkpoint_dir, scratch_path


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default

    def set(self, key, value):
        raise AssertionError("spark.checkpoint.dir is static and must not be set")


class _Ctx:
    def __init__(self, d=None, master="local[4]"):
        self.d = d
        self.master = master

    def getCheckpointDir(self):
        return self.d

    def setCheckpointDir(self, d):
        self.d = d


class _Session:
    def __init__(self, conf_value=None, ctx_dir=None, master="local[4]"):
        self.conf = _Conf(conf_value)
        self.sparkContext = _Ctx(ctx_dir, master)


def test_configured_folder_is_used():
    s = _Session("/mnt/shared/ckpt/")
    assert checkpoint_dir(s) == "/mnt/shared/ckpt"
    assert s.sparkContext.d == "/mnt/shared/ckpt/"
    assert scratch_path(s, "a", "b") == "/mnt/shared/ckpt/chatprep/a/b"


def test_missing_folder_created_for_tests_only():
    s = _Session()
    d = checkpoint_dir(s)
    assert d and s.sparkContext.d == d


def test_missing_folder_raises_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_dir(_Session(master=master))
    assert checkpoint_dir(_Session("hdfs://x/ckpt", master="yarn")) == "hdfs://x/ckpt"
