import math
import random

from mailward.llm.neighbours import nearest, usable


def test_recall_and_exact_scores(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0, 2.0]), (None, [1.0] * 16)]
    frame = usable(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    got = nearest(frame, frame.filter("vec_id % 50 = 0")).collect()
    hit = 0
    for q in range(0, 600, 50):
        best = sorted((math.dist(rows[q][1], v), i) for i, v in rows if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - math.dist(rows[q][1], rows[i][1])) < 1e-9 for _, i, s in mine)
        hit += len({i for _, i in best} & {i for _, i, _ in mine})
    assert hit >= 0.9 * 120
    # The only vector of its length has no neighbour.
    assert not [r for r in got if r.query_id == 1000]


def test_few_and_none(spark):
    frame = usable(spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>"))
    assert [(r.rank, r.vec_id) for r in nearest(frame, frame.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 5), (2, 7)]
    assert nearest(frame.limit(0), frame.limit(0)).count() == 0
