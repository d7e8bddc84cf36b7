from types import SimpleNamespace

import pytest

from lodestrata import runtime


def test_no_machine_local_folder_off_local_mode(spark):
    def session(master, value=None):
        conf = SimpleNamespace(get=lambda k, d=None: value)
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId="x"), conf=conf)

    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(session(master))
        assert runtime.shared_dir(session(master, "hdfs:///x")) == "hdfs:///x"
    assert runtime.shared_dir(session("local[4]")).startswith("file:")


def test_cut_tables_are_freed(spark):
    t = runtime.cut(spark.range(5).toDF("a"), "five")
    path = t.cut_path
    assert t.count() == 5 and runtime.names_in(spark, path)
    runtime.free(t, None, spark.range(1))
    assert runtime.names_in(spark, path) == [] and all(p != path for _, p in runtime._MADE)
    runtime.mark(spark, path + "/b")
    runtime.mark(spark, path + "/a")
    assert runtime.names_in(spark, path) == ["a", "b"]
    runtime.drop_path(spark, path)
