"""Tables, graphs, policies, sources and streams."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulex import CachedSource, CallableSource, DirectorySource, Engine, MemorySource, RuleError, ZipSource
from tabulex.operators import tables
from tabulex.queries import QUERIES, apply, expressions, graph, model, policy, switch, table_content, table_doc
from tabulex.sources.loaders import NoSource, source_from
from tabulex.streaming import write_scored


def rows(df):
    return [tuple(r) for r in df.collect()]


def random_table(r, n):
    values = ["'a'", "'b'", "'c','d'", "", "'e'"]
    sizes = ["", "> 3", "[2..6]", "< 4", "5", "(1..3]", ">= 7"]
    return [(r.choice(values), r.choice(sizes), f"'r{i}'", str(i)) for i in range(n)] + [("", "> 8", "'big'", "-1")]


def test_join_and_chain_agree(spark, monkeypatch):
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.choice("abcdef"), r.choice([None, *range(10)])) for i in range(300)], "i long, k string, n long")
    for trial in range(4):
        # most rules name a value, or the join would not be taken
        doc = table_doc(["k", "n"], ["code", "x.rate"], [(f"'{r.choice('abcdef')}'", *row[1:]) if r.random() < 0.95 else row for row in random_table(r, 60)])
        chain = apply(df, doc)
        monkeypatch.setattr(tables, "JOIN_ROWS", 10)
        joined = apply(df, doc)
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
        monkeypatch.undo()
        assert sorted(rows(chain), key=str) == sorted(rows(joined), key=str), trial


TABLES = [q for q in QUERIES if q.startswith("table_")]


@pytest.mark.parametrize("name", TABLES)
def test_registered_tables_agree_in_both_forms(spark, name, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(tables, "JOIN_ROWS", 10**9)
    chain = sorted(rows(QUERIES[name](spark, d)), key=str)
    monkeypatch.setattr(tables, "JOIN_ROWS", 1)
    assert sorted(rows(QUERIES[name](spark, d)), key=str) == chain


NUMBER_COLUMNS = {"long": [None, -1, 0, 5, 2**53, 2**53 + 1, 2**63 - 1], "double": [None, -0.0, 5.0, 2.5, float(2**53), float("nan")], "decimal(18,2)": [None, "0.10", "2.50", "5.00"], "int": [None, -1, 5, 7], "float": [None, 0.1, 5.0]}
LITERALS = ["5", "5.0", "2.5", "-1", "0.1", "0", "9007199254740992", "9007199254740993", "9223372036854775807", "9007199254740993.0", "1e0", "25e-1"]


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("kind", NUMBER_COLUMNS)
def test_join_compares_numbers_as_the_chain_does(spark, kind, exact, monkeypatch):
    """Random cells over each number type; whichever form is taken, the first rule hit is the same."""
    r = random.Random(len(kind) + exact)
    values = NUMBER_COLUMNS[kind]
    few = [x for x in values if not (exact and x is not None and (x != x or abs(float(x)) > 1e17))]
    df = spark.createDataFrame([(i, None if v is None else str(v), k) for i, (v, k) in enumerate((v, k) for v in few for k in ("a", "b", None))], "i long, v string, k string").select("i", F.col("v").cast(kind).alias("v"), "k")
    literals = [x for x in LITERALS if not exact or len(x) < 18]
    for trial in range(3):
        pool = literals if trial == 1 else [x for x in literals if not set(x) & set(".e")]
        made = []
        for i in range(30):
            a, b = r.choice(pool), r.choice(pool)
            test = r.choice([a, a, a, f"{a}, {b}", f"> {a}", f"<= {a}", f"({a}..{b}]", f">= {a}", f"< {a}"])
            key = r.choice(["'a'", "'b'", "", ""])
            if trial == 2:  # the strings tell the rules apart, and the numbers are a line
                key = r.choice(["'a'", "'b'", "'c'", "'d', 'a'", "'e'", "'f'", "'b'", ""])
                test = r.choice([test, ""]) if i > 3 else r.choice([f"({a}..{b})", f"[{a}..{b}]"])
            made.append((test, key, f"'r{i}'", r.choice(["1", "2.5", "0.1"])))
        doc = table_doc(["v", "k"], ["code", "rate"], [*made, ("", "'a'", "'last'", "7")])
        monkeypatch.setattr(tables, "JOIN_ROWS", 10**9)
        chain = sorted(rows(apply(df, doc, exact=exact).select("i", "code", F.col("rate").cast("string"))))
        monkeypatch.setattr(tables, "JOIN_ROWS", 1)
        assert sorted(rows(apply(df, doc, exact=exact).select("i", "code", F.col("rate").cast("string")))) == chain, (trial, made)


def test_join_where_a_field_fails(spark, monkeypatch):
    """A field that can't be evaluated fails the rules that test it and no others."""
    df = spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "i long, s string")
    doc = table_doc(["number(s)", "i"], ["code"], [("7", "", "'seven'"), ("", "2", "'two'"), ("8", "", "'eight'"), ("", "3", "'three'"), *[(str(x), "", "'far'") for x in (20, 21, 22, 23)]])
    chain = rows(apply(df, doc).select("i", "code"))
    monkeypatch.setattr(tables, "JOIN_ROWS", 1)
    joined = apply(df, doc).select("i", "code")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    assert sorted(rows(joined)) == sorted(chain) == [(1, "seven"), (2, "two"), (3, "three")]


def test_table_details(spark):
    df = spark.createDataFrame([(1, "x"), (5, None), (9, "y")], "n long, s string")
    # an empty output cell leaves the input's value; an output that fails lets the next row try
    doc = table_doc(["n"], ["s", "m"], [("< 3", "", "1"), ("5", "'five'", "number(s)"), ("5", "'other'", "2")], passThrough=True)
    assert rows(apply(df, doc).select("n", "s", "m")) == [(1, "x", 1.0), (5, "other", 2.0), (9, "y", None)]
    # a cell with null deletes the key
    doc = table_doc(["n"], ["s"], [("1", "null"), ("", "'z'")], passThrough=True)
    assert rows(apply(df, doc, into="r", keep=False).select("r.s")) == [(None,), ("z",), ("z",)]
    # collect without a match is empty
    doc = table_doc(["n"], ["c"], [("> 100", "1")], hit="collect")
    assert rows(apply(df, doc).select(F.size("result"))) == [(0,)] * 3
    # columns without a field are expressions
    doc = {**table_doc(["n"], ["c"], [("n > 3 and s == 'y'", "1"), ("", "0")])}
    doc["nodes"][1]["content"]["inputs"][0]["field"] = ""
    assert [x[0] for x in rows(apply(df, doc).select("c"))] == [0, 0, 1]
    # values of different types become a variant
    doc = table_doc(["n"], ["v"], [("1", "'one'"), ("", "2")])
    assert [x[0] for x in rows(apply(df, doc).select(F.to_json("v")))] == ['"one"', "2", "2"]


def test_graph_shapes(spark):
    df = spark.createDataFrame([(1,), (20,)], "n long")
    bad = [
        {"nodes": [], "edges": []},
        graph({"a": expressions(("x", "1"))}, [("in", "a"), ("a", "nowhere")]),
        graph({"a": expressions(("x", "1")), "b": expressions(("y", "2"))}, [("in", "a"), ("a", "b"), ("b", "a")]),
    ]
    for doc in bad:
        with pytest.raises(RuleError):
            apply(df, doc)
    doc = graph({"s": switch("n > 10", ""), "a": expressions(("big", "n * 2")), "b": expressions(("small", "n")), "c": expressions(("sum", "(big ?? 0) + (small ?? 0)"))}, [("in", "s"), ("s", "a", "s0"), ("s", "b", "s1"), ("a", "c"), ("b", "c")])
    assert rows(apply(df, doc).select("n", "sum")) == [(1, 1), (20, 40)]


def test_loop_and_paths(spark):
    df = spark.createDataFrame([(1, [("a", 2.0), ("b", 3.0)]), (2, [])], "k long, items array<struct<name: string, p: double>>")
    doc = graph({"e": expressions(("name", "upper(name)"), ("tax", "p * 0.5"), inputField="items", outputPath="out.list", executionMode="loop", passThrough=True)})
    got = rows(apply(df, doc).select("k", F.to_json("out.list"), F.size("items")))
    assert json.loads(got[0][1]) == [{"name": "A", "p": 2.0, "tax": 1.0}, {"name": "B", "p": 3.0, "tax": 1.5}]
    assert got[1][1] == "[]" and got[0][2] == 2


def test_sub_decisions(spark, tmp_path):
    child = graph({"e": expressions(("y", "x * 2"))})
    parent = graph({"d": ("decisionNode", {"key": "child.json"}), "e": expressions(("z", "y + 1"), ("w", "$nodes.d.y"))})
    loop = graph({"d": ("decisionNode", {"key": "loop.json"})})
    docs = {"child.json": child, "parent.json": parent, "loop.json": loop, "bad.json": {"nodes": [], "edges": []}}
    for k, v in docs.items():
        (tmp_path / k).write_text(json.dumps(v))
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for k, v in docs.items():
            z.writestr(k, json.dumps(v))
    df = spark.createDataFrame([(3,)], "x long")
    for source in (MemorySource(docs), DirectorySource(tmp_path), ZipSource(tmp_path / "all.zip"), CallableSource(docs.__getitem__), CachedSource(MemorySource(docs)), source_from({"type": "fs", "path": str(tmp_path)})):
        assert rows(Engine(source).apply(df, "parent.json").select("z", "w")) == [(7, 6)]
    engine = Engine(DirectorySource(tmp_path))
    with pytest.raises(RuleError, match="too deep"):
        engine.apply(df, "loop.json")
    assert set(engine.compile()) == {"bad.json"}
    for source in (NoSource(), MemorySource(), DirectorySource(tmp_path)):
        with pytest.raises(RuleError):
            source.load("../none.json")


def test_function_nodes(spark):
    df = spark.createDataFrame([("ab",), (None,)], "s string")
    doc = graph({"f": ("functionNode", "export const handler = x => x")})
    with pytest.raises(RuleError, match="no Python function"):
        apply(df, doc)
    out = apply(df, doc, functions={"f": (lambda x: {"n": len(x["s"] or "")}, "n long")})
    assert rows(out.select("n")) == [(2,), (0,)]


def test_exact_numbers(spark):
    df = spark.createDataFrame([(0.1,)], "x double")
    doc = graph({"e": expressions(("y", "x + 0.2"), ("same", "x + 0.2 == 0.3"), ("text", "string(x * 3)"))})
    assert rows(apply(df, doc, exact=True).select("same", "text")) == [(True, "0.3")]
    assert rows(apply(df, doc).select("same")) == [(False,)]


CUSTOMER = model("customer", "age:number", "companies:relationship[]:company", "favourite:reference?:product")


def test_policy_order_and_diagnostics(spark):
    df = spark.createDataFrame([((20.0,),)], "customer struct<age: double>")
    base = model("customer", "age:number")

    def made(*blocks):
        return policy(base, *(("expression", {"key": k, "value": v}) for k, v in blocks))

    assert rows(apply(df, made(("customer.b", "customer.a + 1"), ("customer.a", "customer.age * 2"))).select("customer.b")) == [(41.0,)]
    for doc, word in (
        (made(("customer.a", "customer.b"), ("customer.b", "customer.a")), "Cyclic"),
        (made(("customer.a", "1"), ("customer.a", "2")), "DuplicateWriter"),
        (made(("customer.age", "1")), "InputOverride"),
        (made(("customer.a", "customer.a + 1")), "SelfReferencing"),
        (policy(model("customer", "x:relationship:nobody")), "UnknownDataModelTarget"),
    ):
        with pytest.raises(RuleError, match=word):
            apply(df, doc)
    with pytest.raises(RuleError, match="customer.age"):
        apply(df.select(F.struct(F.lit(1).alias("other")).alias("customer")), made(("customer.a", "customer.age")))


def test_policy_iteration_and_references(spark):
    df = spark.createDataFrame([((30.0, [("a", 1.0), ("b", 5.0)], "p2"), [("p1", "one"), ("p2", "two")])], "customer struct<age: double, companies: array<struct<name: string, revenue: double>>, favourite: string>, product array<struct<id: string, name: string>>")
    doc = policy(
        CUSTOMER, model("company", "name:string", "revenue:number"), model("product", "id:string", "name:string"),
        ("expression", {"key": "customer.total", "value": "sum(map(customer.companies as c, c.scaled))"}),
        ("expression", {"key": "company.scaled", "value": "company.revenue * customer.age"}),
        ("match", {"key": "company.size", "arms": [{"id": "1", "condition": "company.scaled > 100", "value": "'big'"}]}),
        ("expression", {"key": "customer.likes", "value": "customer.favourite.name"}),
    )
    got = apply(df, doc).select("customer.total", "customer.likes", F.col("customer.companies.size").alias("s")).first()
    assert tuple(got) == (180.0, "two", [None, "big"])


def test_policy_imports(spark):
    a = {**policy(("expression", {"key": "customer.b", "value": "customer.a + 1"})), "imports": ["b"]}
    b = {**policy(model("customer", "age:number"), ("expression", {"key": "customer.a", "value": "customer.age"})), "imports": ["a"]}
    df = spark.createDataFrame([((1.0,),)], "customer struct<age: double>")
    assert rows(Engine(MemorySource({"a": a, "b": b})).apply(df, "a").select("customer.b")) == [(2.0,)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 10.0) for i in range(20)], "i long, v double")
    df.write.parquet(str(tmp_path / "in"))
    doc = table_doc(["v"], ["band"], [("> 100", "'high'"), ("", "'low'")])
    engine = Engine(MemorySource({"t": doc}))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    write_scored(engine, stream, "t", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")))) == sorted(rows(engine.apply(df, "t")))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"s{i}", i * 1.0) for i in range(50)], "i long, s string, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    doc = graph({"t": ("decisionTableNode", table_content(["v"], ["band"], [("> 10", "'high'"), ("", "'low'")]))})
    plan = apply(df, doc).where("i > 3").select("band")._jdf.queryExecution().toString()
    scan = plan[plan.rindex("PushedFilters") :]
    assert "GreaterThan(i,3)" in scan and "s:string" not in scan


def test_entry_lists_what_it_has(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "table_first_hit" in __spark_entry__.queries()


def test_pools_given_as_tables(spark, monkeypatch):
    """A repeated id, a null one and one without a row; by broadcast and by shuffle."""
    doc = policy(model("c", "n:reference:nation"), model("nation", "id:string", "name:string"), ("expression", {"key": "c.label", "value": "c.n.name ?? 'none'"}))
    pool = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (None, "z")], "id long, name string")
    df = spark.createDataFrame([(i, (i,)) for i in (1, 2, 3, None)], "k long, c struct<n: long>")
    for most in (100, 0):
        monkeypatch.setattr("tabulex.operators.policy.POOL_ROWS", most)
        got = apply(df, doc, pools={"nation": pool}).select("k", "c.label").collect()
        assert sorted(map(tuple, got), key=str) == [(1, "a"), (2, "b"), (3, "none"), (None, "none")]
    many = policy(model("c", "n:reference[]:nation"), model("nation", "id:string", "name:string"), ("expression", {"key": "c.x", "value": "len(c.n)"}))
    with pytest.raises(RuleError):
        apply(spark.createDataFrame([(1, ([1],))], "k long, c struct<n: array<long>>"), many, pools={"nation": pool})


def test_models_that_disagree_are_an_error(spark):
    df = spark.createDataFrame([(1, (2.0,))], "k long, c struct<x: double>")
    with pytest.raises(RuleError, match="DataModelCollision"):
        apply(df, policy(model("c", "x:number"), model("c", "x:string")))
    assert apply(df, policy(model("c", "x:number"), model("c", "x:number", "y:string?"))).count() == 1
