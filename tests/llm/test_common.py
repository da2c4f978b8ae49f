import os
import random
from types import SimpleNamespace

import pytest

from lumaflow.llm import common


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_running_total(spark, span):
    rng = random.Random(1)
    rows = [(s, b, rng.randint(0, 9)) for s in ("a", "b", None) for b in rng.sample(range(300), 80)]
    df = spark.createDataFrame(rows, "source string, bucket long, n long")
    got = {(r["source"], r["bucket"]): r["before"] for r in common.running_total(df, ["source"], "bucket", "n", "before", span).collect()}
    assert got == {(s, b): sum(n for t, c, n in rows if t == s and c < b) for s, b, _ in rows}


@pytest.mark.parametrize("few", [True, False])
def test_written_tables(spark, few):
    df = common.stash(spark.range(1000, numPartitions=4).withColumnRenamed("id", "x"), "test", few)
    assert df.count() == 1000
    folder = df.stashed_at.removeprefix("file://")
    parts = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert len(parts) == (1 if few else 4)
    common.discard(df)
    assert not os.path.exists(folder)


def test_folder_on_a_cluster():
    """A folder of one machine would lose rows: without the setting a cluster is refused."""
    unset = SimpleNamespace(get=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))
    assert common.shared_dir(session("local[4]")).startswith("file:///")
    told = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "hdfs:///shared"), sparkContext=None)
    assert common.shared_dir(told) == "hdfs:///shared"


def test_batches_are_only_made_smaller(spark):
    before = spark.conf.get(common.BATCH_SETTING)
    try:
        for now, then in (("64m", str(common.BATCH_BYTES)), ("1m", "1m"), ("2048", "2048")):
            spark.conf.set(common.BATCH_SETTING, now)
            common.small_batches(spark.range(1))
            assert common._size(spark.conf.get(common.BATCH_SETTING)) == common._size(then)
    finally:
        spark.conf.set(common.BATCH_SETTING, before)
    assert [common._size(x) for x in ("64m", "67108864b", "1024", "2 kb", "1G")] == [64 << 20, 64 << 20, 1024, 2048, 1 << 30]
