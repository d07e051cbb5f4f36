"""Specialist rows meet the candidates of their query once."""

import random

from lodeseam.operators import evidence

KEY = "query_id int, chunk_id int, path string, start_line int, end_line int"
SCHEMA = f"{KEY}, priority int, score double, content string"


def _expected(existing, additions, most):
    out, some = [], [a for a in additions if (a[2] or "").strip() and (a[7] or "").strip()]
    for query in {r[0] for r in existing + additions}:
        mine, rows = [e for e in existing if e[0] == query], sorted((a for a in some if a[0] == query), key=lambda a: (-a[5], -a[6], a[2:3], a[1], a[3], a[4]))
        first, paths = {}, {}
        for a in rows:
            if a[:5] not in first:
                paths[a[2]] = paths.get(a[2], 0) + 1
                first[a[:5]] = (paths[a[2]] > 1, a)
        held = {e[:5] for e in mine}
        raised = {e[:5] for e in mine if e[:5] in first and first[e[:5]][1][5] > (e[5] or 0)}
        out += [e for e in mine if e[:5] not in raised]
        out += [first[e[:5]][1] for e in mine if e[:5] in raised and first[e[:5]][1][5] > (e[5] or 0)]
        out += [a for _, a in sorted((v for k, v in first.items() if k not in held), key=lambda v: v[0])[:most]]
    return sorted(map(str, out))


def test_specialists_meet_their_query_once(spark):
    draw = random.Random(7)
    row = lambda text: (draw.randrange(6), draw.randrange(4), draw.choice(["a", "b", "c"]), 1, draw.randrange(1, 3), draw.randrange(4), draw.random(), text)
    existing = [row("old") for _ in range(60)] + [(1, 2, None, 1, 1, None, 0.5, "old")]
    additions = [row(draw.choice(["new", "new", " ", None])) for _ in range(120)] + [(9, 1, " ", 1, 1, 3, 0.5, "new"), (8, 1, "a", 1, 1, 3, 0.5, "new")]
    for most in (1, 3):
        found = evidence.merge_specialists(spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(additions, SCHEMA), most)
        assert sorted(str(tuple(r)) for r in found.collect()) == _expected(existing, additions, most)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
