import os

from hushlake.llm.common import discard, scratch_of, written


def test_tables_of_a_block_are_noted_and_discarded(spark):
    path = lambda df: os.path.dirname(df.inputFiles()[0]).removeprefix("file:").replace("///", "/")
    kept = written(spark.range(5))
    with scratch_of() as outer:
        first = written(spark.range(6))
        with scratch_of() as inner:
            second = written(spark.range(7))
    assert [os.path.basename(p) for p in outer] == [os.path.basename(path(first))] and [os.path.basename(p) for p in inner] == [os.path.basename(path(second))]
    where = path(first)
    discard(spark, outer + ["/tmp/there-is-no-such-table"])
    assert not os.path.exists(where) and second.count() == 7 and kept.count() == 5
