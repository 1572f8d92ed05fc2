"""The pipeline's stages on the small tables: each works on what the one before kept."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline as p

    from folioflow.llm import minhash
    from folioflow.llm.common import Workspace

    assert [n for n, _ in p.STAGES][0] == "quality classifier" and len(p.STAGES) == 5
    ws, docs, counts = Workspace(spark, "t"), spark.read.parquet(f"{DIR}/documents.parquet"), []
    columns = docs.columns
    for name, stage in p.STAGES:
        docs = ws.save(stage(spark, docs, DIR), name.replace(" ", "-"))
        counts.append(docs.count())
        if name.startswith("minhash"):
            again = minhash.near_groups(docs, ws, minhash.Plan(5, 80))
            assert again.where("not kept").count() == 0
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] > 0 and docs.where("not exact").count() == 0
