"""Nested records against plain Python."""

import json
import random
import re

from lodeseam.operators import findings, records


def _value(rnd, depth):
    kind = rnd.randrange(7 if depth < 5 else 4)
    if kind == 0:
        return rnd.choice(["", "plain", 'quote " and \\ and \n', "password=abc", "/home/x", "é日", "see https://a:b@c/d"])
    if kind in (1, 2):
        return rnd.choice([1, -7, True, False, None, 2.5])
    if kind in (3, 4):
        return {rnd.choice(["a", "b/c", "d~e", "token", "x y", "Auth", "z"]): _value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def _redacted(v, redact):
    if isinstance(v, dict):
        return {k: "[redacted]" if re.search(findings.SENSITIVE_KEYS, k) else _redacted(x, redact) for k, x in v.items()}
    if isinstance(v, list):
        return [_redacted(x, redact) for x in v]
    return redact[v] if isinstance(v, str) else v


def test_redaction_and_round_trip(spark):
    from pyspark.sql import functions as F

    from lodeseam.functions import text as X

    rnd = random.Random(4)
    held = [_value(rnd, 0) for _ in range(60)] + [[[[[[[["deep", {"k": [[]]}]]]]]]], {}, []]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(held)] + [(900, None)], "id int, record string").withColumn("path", F.lit(1))
    back = {r["id"]: json.loads(r["record"]) for r in records.assemble(records.shred(df)).collect()}
    assert back == dict(enumerate(held))
    strings = {s for v in held for s in re.findall(r'"((?:[^"\\]|\\.)*)"', json.dumps(v))}
    strings = [json.loads(f'"{s}"') for s in strings]
    redact = {r[0]: r[1] for r in spark.createDataFrame([(s,) for s in strings], "s string").select("s", X.redact(F.col("s"))).collect()}
    found = {r["id"]: json.loads(r["record"]) for r in records.redact_records(df).collect()}
    assert found == {k: _redacted(v, redact) for k, v in enumerate(held)}


def _differences(a, b, path=""):
    if isinstance(a, dict) and isinstance(b, dict) or isinstance(a, list) and isinstance(b, list):
        pairs = (lambda x: x.items() if isinstance(x, dict) else enumerate(x))
        drop = records.VOLATILE_KEYS if isinstance(a, dict) else ()
        x, y = ({k: v for k, v in pairs(z) if k not in drop} for z in (a, b))
        rows = []
        for k in {**x, **y}:
            at = f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}"
            if k not in x or k not in y:
                rows.append((at, "added" if k not in x else "removed"))
            else:
                rows += _differences(x[k], y[k], at)
        return rows
    same = json.dumps(a) == json.dumps(b)
    return [] if same else [(path, "changed")]


def test_structural_differences(spark):
    rnd = random.Random(8)
    left = [{"x": _value(rnd, 1), "y": _value(rnd, 1), "duration_ms": k} for k in range(40)]
    right = [{"x": v["x"] if rnd.random() < 0.5 else _value(rnd, 1), "y": v["y"], "duration_ms": -k, **({"new": [1]} if k % 5 == 0 else {})} for k, v in enumerate(left)]
    frame = lambda rows: spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(rows)], "id int, record string")
    found = sorted((r["id"], r["path"], r["change"]) for r in records.compare(frame(left), frame(right)).collect())
    assert found == sorted((k, *d) for k, (a, b) in enumerate(zip(left, right)) for d in _differences(a, b))
    assert records.compare(frame(left), frame(left)).count() == 0
