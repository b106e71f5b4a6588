import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tablewright import session


def fake(master, folder=None):
    state = {"active": None}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: state["active"], setCheckpointDir=lambda d: state.update(active=d))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: folder))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake(master))
    assert session.shared_dir(fake(master, "/shared")) == "/shared"


def test_a_temporary_folder_goes_with_the_session():
    code = "from tablewright.session import _temporary; print(_temporary())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.strip()
    assert "tablewright-" in folder and not os.path.exists(folder)
