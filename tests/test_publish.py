"""Readers of a published table see whole versions only."""

import pytest
from pyspark.sql import functions as F

from corpusweave.sources.publish import publish, published, read_published


def test_versions_are_seen_whole(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    assert published(spark, root) is None
    with pytest.raises(FileNotFoundError):
        read_published(spark, root)
    one = publish(spark.range(5), root)
    reader = read_published(spark, root)
    with pytest.raises(Exception, match="stop here"):
        publish(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("stop here"))).otherwise(F.col("id")).alias("id")), root)
    assert published(spark, root) == one and read_published(spark, root).count() == 5
    two = publish(spark.range(7), root)
    assert published(spark, root) == two != one
    assert reader.count() == 5 and read_published(spark, root).count() == 7  # a reader that had begun keeps its version
