"""Streams over tables that are folders of part files."""

import os

import pytest

from docloom.queries import fixtures as fx
from docloom.queries import jobs  # noqa: F401  (registers its queries)
from docloom.queries.registry import QUERIES


def linked(sf, tmp_path, spark, names):
    """The tables at a new place, the named ones as folders of several files."""
    for f in os.listdir(sf):
        if f.removesuffix(".parquet") in names:
            spark.read.parquet(f"{sf}/{f}").repartition(3).write.parquet(str(tmp_path / f))
        else:
            os.symlink(f"{sf}/{f}", tmp_path / f)
    return str(tmp_path)


@pytest.mark.parametrize("name, part", [("stream_query", "conversations"), ("stream_cdc", "labels"), ("stream_metrics", "events")])
def test_a_stream_reads_a_folder_of_part_files(spark, sf, tmp_path, name, part):
    d = linked(sf, tmp_path, spark, [part])
    want, have = (sorted(map(tuple, QUERIES[name](spark, at).collect())) for at in (sf, d))
    assert have == want and len(have) > 0


def test_a_stream_reads_only_the_table_it_names(spark, tmp_path):
    for name in ("pages", "old_pages", "pages.parquet-old"):
        spark.range(3).selectExpr(f"'{name}' AS t").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = fx.stream(spark, str(tmp_path), "pages").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    got.awaitTermination()
    assert {r.t for r in spark.table("seen").collect()} == {"pages"}
