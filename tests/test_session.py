import types

import pytest

from plumbline.session import scratch_path


def fake(master, folder=None):
    held = {"spark.checkpoint.dir": folder} if folder else {}
    conf = types.SimpleNamespace(get=lambda k, d=None: held.get(k, d),
                                 set=lambda k, v: held.__setitem__(k, v))
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            scratch_path(fake(master), "t")
        assert scratch_path(fake(master, "hdfs://n/shared/"), "t").startswith("hdfs://n/shared/t-")


def test_local_sessions_keep_one_folder():
    session = fake("local[4]")
    first, second = scratch_path(session, "t"), scratch_path(session, "t")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
