from pyspark.sql import functions as F

from designlake.functions import challenge


def test_only_small_pages_are_challenges(spark):
    phrase = "<title>Just a moment...</title><style>p{}</style><p>Verify you are human. Ray ID: 1</p>"
    rows = [(0, phrase, 20), (1, phrase, 60), (2, "<p>A page about paint</p>", 20), (3, "<p>Access DENIED</p>", 5), (4, None, 0)]
    d = spark.createDataFrame(rows, "i int, html string, n int").withColumn("t", challenge.visible_text(F.col("html")))
    got = {r.i: (r.e, r.v) for r in d.select("i", challenge.evidence(F.col("t"), F.col("n")).alias("e"), challenge.vendor(F.col("t"), F.lit("https://a.b/")).alias("v")).collect()}
    assert got[0] == ("verify you are human", "Cloudflare")
    assert got[3] == ("access denied", challenge.OTHER)
    assert got[1][0] is got[2][0] is got[4][0] is None
