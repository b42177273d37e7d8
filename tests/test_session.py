from types import SimpleNamespace

import pytest

from trackloom import session


def fake(master, conf=None, folder=None):
    """What ``shared_folder`` asks of a session."""
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda f: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf or d))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_no_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(master))
    assert session.shared_folder(fake(master, conf="hdfs://shared/")) == "hdfs://shared"
    assert session.shared_folder(fake(master, folder="file:/nfs/shared")) == "file:/nfs/shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_own_folder_in_one_process(master):
    assert session.shared_folder(fake(master)).startswith("file://")
