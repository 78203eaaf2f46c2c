"""Parts of a page's head with attributes in any order and either kind of quotes."""

from designlake.plans.catalogue import META, head_part


def test_head_parts(spark):
    pages = [
        ("<html lang='de' class=x><meta content='One  \n two' name='description'><title> A\n b </title>", ("A b", "de", "One two", None, None, None, None)),
        ('<HTML class="a>b" LANG="fr"><META property="og:image" content="/a.png"><link href=\'/i.ico\' rel="shortcut icon">', (None, "fr", None, None, "/a.png", None, "/i.ico")),
        ('<meta name="description2" content="no"><meta name="descriptions" content="no"><meta name=generator content="It\'s > 1"><meta name="theme-color" content="">', (None, None, None, None, None, "It's > 1", None)),
        ('<meta data-name="description" content="no"><metadata name="description" content="no"><meta name="description" content="first"><meta name="description" content="second">', (None, None, "first", None, None, None, None)),
        ("", (None,) * 7),
        (None, (None,) * 7),
    ]
    d = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(pages)], "k int, html string")
    got = [tuple(r)[1:] for r in d.select("k", *[head_part(d.html, k).alias(k) for k in META]).orderBy("k").collect()]
    assert got == [w for _, w in pages]
    long = spark.createDataFrame([("<title>" + "x" * 5000 + "</title>",)], "html string")
    assert len(long.select(head_part(long.html, "title")).first()[0]) == 200
