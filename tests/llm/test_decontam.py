import random

import numpy as np

from designlake.llm import decontam


def test_edited_copy_of_an_item_that_leaked_often(spark):
    rng = random.Random(9)
    item = [f"w{i}" for i in range(40)]
    text = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    edited = [f"y{i}" if i in range(2, 21, 3) else w for i, w in enumerate(item)]
    # one run of three words is left of this one, and pairs
    sparse = [f"z{i}" if i % 3 == 2 and i != 20 else w for i, w in enumerate(item)]
    docs = [text(30) + item + text(20) for _ in range(40)] + [text(9) + edited + text(9), text(9) + sparse + text(9), text(80)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in decontam.clean(frame, bench).collect()] == [42]


def test_skipped_alignments_are_below_the_score():
    rng = np.random.default_rng(3)
    skipped = 0
    for _ in range(3000):
        m, score = int(rng.integers(1, 12)), float(rng.choice([0.3, 0.5, 0.8]))
        item, text = (rng.integers(0, 14, n).astype(np.uint64) for n in (m, rng.integers(1, 40)))
        if not decontam.may_reach(np.unique(item), text, m, score):
            skipped += 1
            assert decontam.align(item, text)[0] < score * decontam.MATCH * m
    assert skipped > 100
