from pyspark.sql import functions as F

from designlake.functions.url import normalized


def test_normalized(spark):
    cases = {
        "Shop.Example": "https://shop.example/",
        "https://Ann:Pw@Shop.Example:443/A b?x=&utm_medium=q&y&&z=1 2#top": "https://Ann:Pw@shop.example/A%20b?x=&y=&z=1+2",
        "HTTP://shop.example:8080?GCLID=7": "http://shop.example:8080/",
        "http://shop.example:80/?&a=%20": "http://shop.example/?&a=%20",
        "shop.example/?": "https://shop.example/?",
        "shop.example/p?reference=1&ref_x=2": "https://shop.example/p?reference=1",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.n for r in df.select("u", normalized(F.col("u")).alias("n")).collect()} == cases
