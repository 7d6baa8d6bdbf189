"""Examples of verb classes."""

from lexispark.sources import tables as S


def test_classes_of_examples_are_reduced_before_texts(spark):
    examples = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (2, "x"), (3, "y"), (4, "z")], "example_id long, example string")
    frames = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 12), (4, 99)], "example_id long, frame_id long")
    classes = spark.createDataFrame([(10, 7), (11, 3), (12, 5), (12, None)], "frame_id long, class_id long")
    none = spark.createDataFrame([], "class_id long, class_name string, synset_id string, wordid long, vnwordid long, role_type_id long, role_type string")
    out = S.import_verb_classes(none, none, none.select("class_id", "role_type_id"), none.select("role_type_id", "role_type"), examples, frames, classes)["examples"]
    assert sorted(map(tuple, out.collect())) == [(1, 3, "a"), (2, 7, None), (3, None, "y")]
    before = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [example_id" in before
