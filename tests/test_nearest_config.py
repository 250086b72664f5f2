"""Nearest config folders against a plain walk upwards."""

from __future__ import annotations

import random

from assetloom.operators import lint as L


def plain(paths, configs):
    def nearest(path):
        d = path.rpartition("/")[0]
        while d not in configs and d:
            d = d.rpartition("/")[0]
        return (d, configs[d]) if d in configs else (None, None)
    return sorted((p, *nearest(p)) for p in paths)


def test_random_trees_over_many_partitions(spark):
    pick = random.Random(4)
    names = ["a", "b", "ab", "a b", "a-", "é"]
    paths = ["/".join(pick.choice(names) for _ in range(pick.randrange(5))) for _ in range(600)]
    paths = [f"{d}/f{i}.png" if d else f"f{i}.png" for i, d in enumerate(paths)]
    paths += [f"a/b/f{i}.png" for i in range(600)] + ["a/b/f1.png"]  # one folder holds half of them
    rows = spark.createDataFrame([(p,) for p in paths], "path STRING").repartition(5)
    for chosen in ({"": 1, "a/b": 2, "a/b/a": 3}, {"a": 1}, {"ab": 1, "a": 2, "a-/b": 3, "a b/a/b": 4}, {}, {"a/b": 7}):
        dirs = spark.createDataFrame(list(chosen.items()), "dir STRING, config INT")
        for parts in (1, 4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            try:
                got = sorted(tuple(r) for r in L.nearest_config(rows, dirs).collect())
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", 4)
                spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
            assert got == plain(paths, chosen)


def test_a_crowded_folder_is_dealt_to_several_tasks(spark):
    rows = spark.range(4000).selectExpr("concat('x/y/', id, '.png') AS path")
    dirs = spark.createDataFrame([("x", "root")], "dir STRING, config STRING")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = L.nearest_config(rows, dirs)
        assert out.where("dir = 'x' and config = 'root'").count() == 4000
        walked = spark.read.parquet(out.inputFiles()[0].rpartition("/")[0])
        sizes = [r["count"] for r in walked.where("level is null or level >= 0").groupBy("p").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_null_paths_and_empty_tables(spark):
    dirs = spark.createDataFrame([("a", "x")], "dir STRING, config STRING")
    rows = spark.createDataFrame([(None,), ("a/b.png",), ("top.png",)], "path STRING")
    assert sorted((str(r.path), r.dir, r.config) for r in L.nearest_config(rows, dirs).collect()) == [("None", None, None), ("a/b.png", "a", "x"), ("top.png", None, None)]
    assert L.nearest_config(rows.limit(0), dirs).count() == 0
