"""Models that are replaced as a whole."""

from __future__ import annotations

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from ferrule.sources import versions as V


def test_a_version_appears_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    assert V.current(spark, root).version == 0 and V.versions(spark, root) == []
    one = {"a": spark.range(5).toDF("k"), "b": spark.range(3).toDF("k")}
    first = V.replace_model(spark, root, one)
    pinned = V.current(spark, root)
    assert pinned == first and pinned.version == 1
    broken = spark.range(4).select(F.udf(lambda k: 1 // 0, "long")("id").alias("k"))
    with pytest.raises(PythonException):
        V.replace_model(spark, root, {"a": spark.range(9).toDF("k"), "b": broken})
    assert V.current(spark, root) == pinned and pinned.read("a").count() == 5
    second = V.replace_model(spark, root, {"a": spark.range(7).toDF("k")})
    assert pinned.read("a").count() == 5 and pinned.read("b").count() == 3
    assert V.current(spark, root) == second and set(second.paths) == {"a"} and V.versions(spark, root) == [1, 2]
    assert V.current(spark, root, 1) == pinned
    with pytest.raises(ValueError, match="no version 9"):
        V.current(spark, root, 9)
    with pytest.raises(Exception, match="(?i)exists"):
        V.replace_parts(pinned, {"a": spark.range(1).toDF("k")}, "k")  # of two writers from one version, one wins
    assert V.unused(spark, root, [2]) == sorted(pinned.paths.values())


def test_parts_of_a_model_are_replaced(spark, tmp_path):
    files = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("z", 4)], "file string, v int")
    base = V.replace_model(spark, str(tmp_path), {"methods": files, "calls": files, "settings": spark.range(2)})
    changed = spark.createDataFrame([(9, "x"), (8, "new")], "v int, file string")
    now = V.replace_parts(base, {"methods": changed}, "file", spark.createDataFrame([("z",)], "file string"))
    rows = lambda t: sorted(tuple(r) for r in now.read(t).collect())
    assert rows("methods") == [("new", 8), ("x", 9), ("y", 3)] and rows("calls") == [("x", 1), ("x", 2), ("y", 3)]
    assert now.paths["settings"] == base.paths["settings"] and base.read("methods").count() == 4
