from lumaflow.model import Camera, Extent, Phase
from lumaflow.operators.demosaic import demosaic_2x2
from lumaflow.sources.rasters import bound_mosaic
from lumaflow.streaming.frames import develop_stream


def test_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    frames = [bound_mosaic(spark, [float(k + i) for i in range(16)], Extent(4, 4), Phase.RGGB, Camera("", ""), image_id=k).data for k in range(3)]
    develop = lambda df: demosaic_2x2(df, Phase.RGGB, Extent(4, 4))
    for part in (frames[:2], frames[2:]):
        for f in part:
            f.coalesce(1).write.mode("append").parquet(source)
        query = develop_stream(spark, source, target, str(tmp_path / "state"), develop, files_per_trigger=1)
        assert query.awaitTermination(120)
    want = develop(frames[0].union(frames[1]).union(frames[2]))
    assert sorted(map(tuple, spark.read.parquet(target).drop("batch").collect())) == sorted(map(tuple, want.collect()))
