"""Queries over lists of properties take the whole lists."""

from lexispark import plans

WORDS = [f"w{chr(97 + k)}" for k in range(22)]


def folder(spark, path):
    spark.createDataFrame([(1, " ".join(WORDS)), (2, "wa wv zz")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_properties_beyond_the_fifteenth_are_curated(spark, tmp_path):
    got = plans.QUERIES["curate_properties"](spark, folder(spark, tmp_path)).collect()
    assert [(r.property_id, r.text) for r in sorted(got)] == list(enumerate([*WORDS, "zz"], 1))
    assert "<= 15" not in plans.SQL["curate_properties"]


def test_links_of_properties_beyond_the_fifteenth(spark, tmp_path):
    got = plans.QUERIES["populate_properties"](spark, folder(spark, tmp_path)).collect()
    assert sorted((r.synset_id, r.property_id) for r in got) == [*(("1", k) for k in range(1, 23)), ("2", 1), ("2", 22), ("2", 23)]
    assert "<= 15" not in plans.SQL["populate_properties"]
