"""The shared folder, tables between steps and names of helper columns."""

import os
from types import SimpleNamespace

import pytest

from leafline import session


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda k, d=None: folder)
    return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=SimpleNamespace(get=lambda k, d=None: None))


def test_folder():
    assert session.checkpoint_root(fake("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.checkpoint_root(fake("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError):
            session.checkpoint_root(fake(master))


def test_scratch(spark):
    outer = session.cut(spark.range(3), "outer")
    with session.scratch(spark) as keep:
        inner = session.cut(spark.range(5), "inner")
        kept = keep(inner.where("id > 1"), "kept")
        places = [x.inputFiles()[0].removeprefix("file://") for x in (outer, inner, kept)]
    assert kept.count() == 3 and outer.count() == 3
    assert [os.path.exists(p) for p in places] == [True, False, True]
    with pytest.raises(RuntimeError), session.scratch(spark):
        lost = session.cut(spark.range(5), "lost").inputFiles()[0].removeprefix("file://")
        raise RuntimeError
    assert not os.path.exists(lost)


def test_fresh():
    assert session.fresh(["a", "B", "_b"], "b", "c", "c") == ["__b", "c", "_c"]
