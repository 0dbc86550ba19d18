import os

from chronomesh.llm import common, nearcopies, simhash


def paths(df):
    return {f.rsplit("/", 1)[0].removeprefix("file://") for f in df.inputFiles()}


def test_tables_go_with_their_scope(spark):
    df = spark.range(5)
    with common.temporary(spark):
        (outer,) = paths(common.stored(df, "a"))
        with common.temporary(spark):
            (inner,), (handed,) = paths(common.stored(df, "b")), paths(common.stored(df, "c", result=True))
            assert os.path.isdir(inner)
        assert not os.path.isdir(inner) and os.path.isdir(handed) and os.path.isdir(outer)
    assert not os.path.isdir(outer) and not os.path.isdir(handed)
    (kept,) = paths(common.stored(df, "d"))
    with common.temporary(spark):
        (result,) = paths(common.stored(df, "e", result=True))
    assert os.path.isdir(kept) and os.path.isdir(result)


def test_operators_leave_their_results_alone(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string")
    for make in (simhash.near_duplicates, nearcopies.near_copies):
        before = set(os.listdir(folder))
        assert make(docs).count() == 3
        assert len(set(os.listdir(folder)) - before) == 1
