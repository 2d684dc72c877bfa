from pathlib import Path
from types import SimpleNamespace

import pytest

from pairloom.plans import work


def test_tables_are_deleted_at_the_end_of_the_block(spark):
    with work.Workspace(spark, "t") as w:
        df = w.save(spark.range(5), "five")
        at = Path(w.root.removeprefix("file://"))
        assert df.count() == 5 and (at / "five").exists()
        w.drop("five")
        assert not (at / "five").exists()
        w.save(spark.range(2), "two")
    assert not at.exists() and not any(p == w.root for _, p in work._made)


@pytest.mark.parametrize("master, fine", [("local", True), ("local[8]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    if fine:
        assert work.shared_root(session).startswith("file://")
    else:
        with pytest.raises(RuntimeError):
            work.shared_root(session)
