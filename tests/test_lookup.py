"""Look-ups of symbols that share their names."""

from lodeseam.operators import evidence, graph


def _tables(spark):
    names = ["Run", "run_all", "stop", "Run", "rerun"]
    symbols = [(k, names[k % 5], f"pkg.{'ab'[k % 2]}.{names[k % 5]}" if k % 11 else None) for k in range(120)]
    queries = [(k, ["RUN", "a.run", "pkg.b.stop", "un", "zzz", ""][k % 6]) for k in range(60)]
    return spark.createDataFrame(symbols, "symbol int, name string, qualified string"), spark.createDataFrame(queries, "query_id int, query string"), symbols, queries


def _expected(symbols, queries, top):
    out = []
    for i, query in queries:
        q, found = query.lower(), []
        for s, n, u in symbols:
            n, u = n.lower(), u and u.lower()
            if q and (q in n or (u and q in u)):
                r = 0 if u == q else 1 if u and u.endswith("." + q) else 2 if n == q.split(".")[-1] else 3
                found.append((r, [-ord(c) for c in u] + [1] if u else [2], s))  # the last name first, none at the end
        out += [(i, p, s, ("exact", "suffix", "short_name", "substring")[r]) for p, (r, _, s) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_copies_of_a_name_are_searched_once(spark):
    symbols, queries, a, b = _tables(spark)
    for top in (1, 5, 200):
        found = graph.symbol_lookup(queries, symbols, top)
        assert sorted(tuple(r) for r in found.collect()) == _expected(a, b, top)
    assert "windowspecdefinition(query_id" not in found._jdf.queryExecution().toString()  # no row for each pair of a query and a copy


def test_summary_equals_the_view(spark):
    symbols, queries, _, _ = _tables(spark)
    relations = spark.createDataFrame([(str(k), "calls", k % 7, k % 50) for k in range(200)], "relation_id string, kind string, source int, target int")
    view = graph.structure_view(queries, symbols, relations).collect()
    found = graph.structure_summary(queries, symbols, relations)
    expected = {}
    for r in view:
        expected.setdefault((r["query_id"], r["symbol"], r["direction"]), []).append(r["other"])
    got = {(r["query_id"], r["symbol"], r["direction"]): (r["relations"], r["least"]) for r in found.collect()}
    assert got == {k: (0, None) if v == [None] else (len(v), min(v)) for k, v in expected.items()}
    assert found.count() == len(got)


def test_definitions_of_shared_names(spark):
    symbols, _, rows, _ = _tables(spark)
    units = spark.createDataFrame([(k, "p.py", 1, 2, "text" if k % 3 else " ") for k in range(120)], "unit_id int, path string, start_line int, end_line int, content string")
    asked = spark.createDataFrame([(k, "what does x.b.stop do" if k % 2 else "what does b.stop do") for k in range(8)], "query_id int, query string")
    found = evidence.named_definitions(asked, symbols.withColumn("unit_id", symbols["symbol"]), units)
    first = min(k for k, n, u in rows if u == "pkg.b.stop" and k % 3)
    assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == [(k, first) for k in range(8)]
