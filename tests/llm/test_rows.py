"""The pipeline's stages that drop copies keep one row of each group whatever frame the rows come from."""

import pytest

import corpus_pipeline
from fixtures import words
from tapewright.llm.common import written

TEXTS = [" ".join(words(40, i)) for i in range(6)]


def frames(spark, path):
    """Frames in which rows of files repeat: by a join, a sample with replacement, a path read twice, a union, a generator."""
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1).write.parquet(path)
    once = spark.read.parquet(path)
    two = written(spark.range(2).withColumnRenamed("id", "side"), "two")
    return {
        "plain": once, "join": once.join(two, on=once.doc_id >= -1 - two.side), "sample": once.sample(True, 3.0, 5), "twice": spark.read.parquet(path, path), "union": once.union(once),
        "exploded": once.selectExpr("doc_id", "text", "explode(array(1, 2)) AS side"), "chosen": once.selectExpr("doc_id", "text", "1 AS file", "2 AS row").where("doc_id > 1"),
    }


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_one_row_of_each_text_stays(spark, sf, tmp_path, monkeypatch, stage):
    cases = frames(spark, str(tmp_path / "docs"))
    some = [*cases] if stage is corpus_pipeline.drop_copies else ["plain", "join", "sample", "twice"]
    for i, name in enumerate([*some, "plain", "join"]):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 2_000_000 if i < len(some) else 0)  # both ways of leaving rows out
        docs = cases[name]
        want = sorted({(r["doc_id"], r["text"]) for r in docs.collect()})
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want, name


def test_places_are_used_where_they_are_sure(spark, tmp_path):
    for name, docs in frames(spark, str(tmp_path / "docs")).items():
        placed, place, _ = corpus_pipeline.numbered(docs, "x")
        by_file = placed.select(place[0]).distinct().first()[0] != 0
        assert by_file == (name == "plain"), name
        assert placed.count() == docs.count() == placed.select(place).distinct().count()
