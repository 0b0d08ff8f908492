import __spark_entry__ as entry


def test_shingles_are_made_once_a_text(spark):
    plan = entry.queries()["d03_shingles"](spark, entry.SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
