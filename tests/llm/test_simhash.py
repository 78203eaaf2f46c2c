import random

from designlake.llm import simhash


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    # two texts without any id, one with and without, two that share an id, repeated rows
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (None, c, "x"), (7, c, "x"), (3, d, "x"), (3, e, "x"), (3, e, "x"), (None, a, None)]
    for data in (rows, rows[::-1]):
        docs = spark.createDataFrame(data, "doc_id long, text string, row_mark string")
        got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
        assert got == sorted([(None, a), (None, b), (7, c), (3, d), (3, e)], key=str)


def test_stages_keep_columns_of_any_name(spark):
    from designlake.llm import mixing, quality

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12)) + " the of and", "s" if i % 2 else None, 1, 2, 3, 4) for i in range(20)] + [(None, None, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, turns int, _turns int, _kept int, `a.b` int")
    for stage in (quality.keep, simhash.one_of_each, mixing.mixed):
        out = stage(docs)
        assert out.columns == docs.columns and {r.text for r in out.collect()} >= ({r[1] for r in rows[:20]} if stage is not mixing.mixed else set())
        assert stage(docs.limit(0)).collect() == []
