from pyspark.sql import functions as F

from rostra.llm.scans import paragraphs, scan_marks, skeleton

CLEAN = "The harbour board would explain the harvest before the committee which had repealed that well-known statute of the municipalities. " * 12


def test_skeletons():
    for bad, good in (("tbeir", "their"), ("bef0re", "before"), ("wliich", "which"), ("clecision", "decision"), ("custorns", "customs"), ("vvould", "would"), ("ſalary", "salary"), ("fáctory", "factory"), ("5chool", "school"), ("f!shery", "fishery"), ("accoiint", "account"), ("tariners", "tanners"), ("qeneral", "general"), ("pu6lic", "public"), ("thal", "that")):
        assert skeleton(bad) == skeleton(good), bad
    assert skeleton("harbour") != skeleton("harvest")


def test_marks(spark, clash):
    page = (
        "{22 MAY 1959}  Brimholme Treaty\np. 138\nThe hárbour board w0uld explain the har-\nvest before the commi-\n\n{22 MAY 1959}  Brimholme Treaty\np. 139\n\n"
        "ttee which had repealed that well-\nknown statute of the munici¬\npalities in the year of\n1959."
    )
    rows = [(1, page, True), (1, page, True), (2, None, True), (3, "", True), (4, CLEAN, False), (None, "One line of 3 words", True), (5, "H O U S E   O F   L O R D S\nThe harvest which repealed the statute of the board and\n[12]\nthe committee.", None)]
    df = clash(spark.createDataFrame(rows, "speech_id long, body string, scan boolean"))
    got = {tuple(r) for r in scan_marks(df, "speech_id", "body", F.col("scan")).collect()}
    header = "{22 MAY 1959}  Brimholme Treaty"
    want = {("header", header), ("pageno", "p. 138"), ("pageno", "p. 139"), ("misread", "harbour"), ("misread", "would"), ("hyphen", "harvest"), ("hyphen", "committee"), ("hyphen", "well-known"), ("hyphen", "municipalities")}
    assert got == {(1, *w) for w in want}
    assert scan_marks(df.limit(0), "speech_id", "body", F.col("scan")).count() == 0

    paras = {r["body"] for r in paragraphs(df.filter("speech_id is null or speech_id <> 5"), "speech_id", "body", F.col("scan")).filter("speech_id = 1").collect()}
    assert paras == {"The harbour board would explain the harvest before the committee which had repealed that well-known statute of the municipalities in the year of 1959."}


def test_title_matter_that_heads_other_pages(spark):
    page = "Orders Of The Day\n\nThe harvest which repealed the statute of the board and the committee went on\nthe whole night of that day and the next."
    inside = "The House met in the\nOrders Of The Day\nmorning and sat long\nuntil the night came"
    rows = [(i, page.replace("Day", f"Day [{i}]"), True) for i in range(3)] + [(9, inside, True), (10, CLEAN, False)]
    df = spark.createDataFrame(rows, "speech_id long, body string, scan boolean")
    heads = lambda x: {tuple(r)[::2] for r in scan_marks(x, "speech_id", "body", F.col("scan")).filter("kind = 'header'").collect()}
    assert heads(df) == {(i, f"Orders Of The Day [{i}]") for i in range(3)} | {(9, "Orders Of The Day")}
    assert heads(df.filter("speech_id > 1")) == {(2, "Orders Of The Day [2]")}


def test_words_beyond_the_known_ones(spark, monkeypatch):
    from rostra.llm import scans

    page = "The hárbour board w0uld explain the harvest before the\ncommittee which had repealed the well-known statute and\nthe harvest 0f the harbour board."
    df = spark.createDataFrame([(1, page, True), (4, CLEAN, False)], "speech_id long, body string, scan boolean")
    want = sorted(map(tuple, scan_marks(df, "speech_id", "body", F.col("scan")).collect()))
    monkeypatch.setattr(scans, "KNOWN", 1)
    assert sorted(map(tuple, scan_marks(df, "speech_id", "body", F.col("scan")).collect())) == want and len(want) == 3
