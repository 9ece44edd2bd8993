from rostra.llm import sampling

DDL = "speech_id long, era string, speech_type string, seed_present boolean, snapshot_no int, place string"


def test_members_stay(spark):
    first = [(i, "e", "short", i % 3 == 0, 1, "?") for i in range(3000)] + [(None, "e", "short", True, 1, "?"), (5000, None, None, None, None, "?")]
    one = {tuple(r) for r in sampling.speech_sample(spark.createDataFrame(first, DDL)).collect()}
    more = first + first[:100] + [(i, "other", "long", i % 3 != 0, 2, "?") for i in range(0, 3000, 2)] + [(9000 + i, "e", "short", True, 2, "?") for i in range(2000)]
    two = {tuple(r) for r in sampling.speech_sample(spark.createDataFrame(more, DDL).repartition(7)).collect()}
    assert one <= two and len(two) > len(one)
    drawn = [r for r in one if r[3] is True]
    assert 140 < len(drawn) < 260 and all(r[4] < (0.2 if r[3] else 0.1) for r in two)
    assert sampling.speech_sample(spark.createDataFrame([], DDL)).count() == 0
