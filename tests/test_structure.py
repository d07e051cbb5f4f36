"""The structure view: a question's term, the symbols it lists, and every relation at them."""

import re

from lodeseam.operators import graph


def _tables(spark):
    names = ["run_all", "runXall", "Parse", "stop", "a.b"]
    symbols = [(k, names[k % 5], f"pkg.{'ba'[k % 2]}.{names[k % 5]}", f"f(x: Unit{k % 3})" if k % 4 else None, k + 1000, "p.py") for k in range(90)]
    questions = ["What does run_all call?", "which tests affect PARSE", "Where is Unit2 used?", "pkg.a.stop", "___", "", "what does Nothing_here do", "\\", None]
    relations = [(f"r{k}", "calls", k % 7, k % 90) for k in range(900)]
    return (
        spark.createDataFrame(list(enumerate(questions)), "query_id int, query string"),
        spark.createDataFrame(symbols, "symbol int, name string, qualified string, signature string, unit_id int, path string"),
        spark.createDataFrame(relations, "relation_id string, kind string, source int, target int"),
        symbols, relations,
    )


#: The term of each question.
TERMS = ["run_all", "PARSE", "Unit2", "pkg.a.stop", "___", "", "Nothing_here", "\\", ""]


def _listed(symbols, most=20):
    found = {}
    for i, term in enumerate(TERMS):
        like = re.compile(".*" + "".join("." if c == "_" else re.escape(c) for c in term) + ".*", re.I | re.S)
        rows = sorted((u, s) for s, n, u, g, _, _ in symbols if any(like.fullmatch(t) for t in (n, u, g) if t is not None))
        found[i] = [s for _, s in rows[:most]]
    return found


def test_view_lists_the_symbols_of_a_question_by_name(spark):
    questions, symbols, _, rows, _ = _tables(spark)
    expected = _listed(rows)
    assert len(expected[0]) == 20 and expected[2] and not expected[6] and len(expected[4]) == len(expected[5]) == 20 and not expected[7]
    found = graph.listed_symbols(questions, symbols).collect()
    assert sorted((r["query_id"], r["position"], r["symbol"]) for r in found) == [(i, p, s) for i, listed in expected.items() for p, s in enumerate(listed, 1)]


def test_view_holds_every_relation_of_its_symbols(spark, monkeypatch):
    questions, symbols, relations, rows, edges = _tables(spark)
    expected = []
    for i, listed in _listed(rows).items():
        for p, s in enumerate(listed, 1):
            ends = [(e, kind, "out", b) for e, kind, a, b in edges if a == s] + [(e, kind, "in", a) for e, kind, a, b in edges if b == s]
            expected += [(i, p, s, s + 1000, "p.py", *end) for end in ends or [(None, None, None, None)]]
    assert max(sum(r[0] == i and r[5] is not None for r in expected) for i in range(len(TERMS))) > 100
    for most_rows in (graph.VIEW_ROWS, 30):  # with 30 a symbol's rows are dealt to several tasks
        monkeypatch.setattr(graph, "VIEW_ROWS", most_rows)
        found = graph.structure_view(questions, symbols, relations)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_query_gives_relations_and_not_their_number(spark, tmp_path):
    from lodeseam import catalog

    spark.createDataFrame([(1, "old ring", "Brand#1", "SMALL"), (2, "hot bolt", "Brand#2", "LARGE")], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(2,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, 2, 9, 1), (7, 2, 8, 2), (8, 1, 2, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()["structure_view"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["symbol"], r["path"], r["relation_id"], r["direction"], r["other"]) for r in found) == [
        (2, 2, "Brand#2", "7-1", "out", 9), (2, 2, "Brand#2", "7-2", "out", 8), (2, 2, "Brand#2", "8-1", "in", 1),
    ]
