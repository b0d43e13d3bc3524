"""Column functions on literal rows, and streaming segmentation for every way to cut an answer."""

import pytest
from pyspark.sql import functions as F

from symtrail.functions import answers as A, paths as P, questions as Q, text as X
from symtrail.streaming import validator


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_identifiers(spark):
    cases = {"get_user_by_id": ["get", "user", "by", "id"], "getUserById": ["get", "User", "By", "Id"], "HTTPResponseHandler": ["HTTP", "Response", "Handler"],
             "oauth2Client": ["oauth", "2", "Client"], "a.b/c:d-e": ["a", "b", "c", "d", "e"], "": []}
    assert column(spark, list(cases), X.split_identifier) == list(cases.values())
    assert column(spark, ["getUserById get"], X.tokenize_query) == [["getuserbyid", "get", "user", "by", "id"]]


def test_scrub(spark):
    hidden = {"SECRET_KEY = 'abc123!def'": "abc123!def", "token: \"0123456789abcdef\"": "0123456789abcdef", "db = postgres://u:hunter2@h/x": "hunter2",
              "k = sk-ant-" + "a" * 24: "a" * 24, "k = sk-proj-" + "b" * 24: "b" * 24, "AKIA" + "A1" * 8: "A1A1", "x = 'ghp_" + "c" * 36 + "'": "c" * 36,
              "'PASSWORD': 's3cret!!x'": "s3cret!!x", "d = 'django-insecure-abcdefghijk'": "abcdefghijk", "v = '" + "Z9" * 20 + "'": "Z9" * 20}
    for text, out in zip(hidden, column(spark, list(hidden), X.scrub)):
        assert hidden[text] not in out and "«redacted»:" in out
    plain = ["password = get_password()", "token = 'Bearer'", "url = '/api/token/'", "if secret_name == other:", "sha = '0123abc'", "password: str"]
    assert column(spark, plain, X.scrub) == plain
    assert column(spark, ["db = postgres://u:hunter2@h/x"], X.scrub) == ["db = postgres://u:«redacted»:url_password@h/x"]


def test_paths(spark):
    assert column(spark, ["authx/views.py", "authx/__init__.py", "./a\\b.pyi", "__init__.py"], P.py_module) == ["authx.views", "authx", "a.b", ""]
    assert column(spark, [".models.User", "..x", "...deep.y", "plain", "."], lambda c: P.absolutize(c, F.lit("a.b"))) == ["a.b.models.User", "a.x", "deep.y", "plain", "a.b"]
    assert column(spark, ["../lib/u", "@/lib/u", "react", "./", "../../../../x"], lambda c: P.ts_specifier(c, F.lit("app/api/r.ts"))) == ["app.lib.u", "lib.u", "react", "./", "../../../../x"]
    assert column(spark, ["/x/site-packages/y.py", "lib/python/own.py", "/usr/lib/python3.12/a.py", "node:fs"], P.is_library) == [True, False, True, True]
    assert column(spark, ["a/../b", "C:\\x", "../a", "ok/a.py", ""], P.is_unsafe) == [True, True, True, False, True]
    lines = ['R  old.py -> new.py', 'RM "caf\\303\\251 x.py" -> y.py', "?? z.py", "R  same -> same"]
    assert [tuple(m) if m else None for m in column(spark, lines, P.git_rename)] == [("old.py", "new.py"), ("café x.py", "y.py"), None, None]


def test_routes_and_traces(spark):
    cases = {"what calls charge_card": ("STRUCTURAL", "callers"), "what does the view call": ("STRUCTURAL", "callees"), "where is X used": ("STRUCTURAL", "usages"),
             "what eventually calls x": ("STRUCTURAL", "impact"), "how does login work": ("SEMANTIC", "explanatory"), "login": ("SEMANTIC", None),
             '  File "/a/b.py", line 3, in run': ("TRACE", "stack_trace"), "    at async GET (file:///C:/app/x.js:10:5)": ("TRACE", "stack_trace"), "we met at noon (really)": ("SEMANTIC", None)}
    got = column(spark, list(cases), Q.route)
    assert [(r.query_class, r.rule) for r in got] == list(cases.values())
    js = "TypeError: x\n    at async Object.load (webpack-internal:///./src/a.ts:12:7)\n    at t (/app/.next/server/chunks/1.js:1:99)\n    at <anonymous>\n    at new Foo (C:\\app\\x.js:3:4)"
    frames = column(spark, [js], Q.stack_frames)[0]
    assert [(f.fn_name, f.line_no, f.col_no) for f in frames] == [("Object.load", 12, 7), ("t", 1, 99), ("<anonymous>", None, None), ("Foo", 3, 4)]
    assert column(spark, ["Traceback (most recent call last):\nboom"], Q.stack_frames)[0][0].raw == "Traceback (most recent call last):"
    assert column(spark, ["who calls login", "use `a.b` or c", "callers of get_user and run()"], Q.entity_terms) == [["login"], ["a.b"], ["get_user", "run"]]


ANSWER = ("The `run` function calls `stop` in fact. [C1][C2] It may fail, e.g. when idle. See [C3].\n"
          "```py\nx = a[C9]. y\n```\nIs it? The class is 3.5 wide! [C4] Tail without end [C5]")


def test_sentences_and_claims(spark):
    out = column(spark, [ANSWER], A.sentences)[0]
    assert out == ["The `run` function calls `stop` in fact. [C1][C2]", "It may fail, e.g. when idle.", "See [C3].", "```py\nx = a[C9]. y\n```", "Is it?",
                   "The class is 3.5 wide! [C4]", "Tail without end [C5]"]
    assert column(spark, out, A.handles) == [[1, 2], [], [3], [], [], [4], [5]]
    assert column(spark, out, A.claim_reason) == ["handle", "hedged", "imperative", "empty outside fenced code", "interrogative", "handle", "handle"]


def test_relations(spark):
    cases = {"The `issue_token` function calls the `audit_event` helper.": [("issue_token", "CALLS", "audit_event")],
             "`post` method of the `LoginView` class invokes `x`": [("LoginView.post", "CALLS", "x")], "`a` is called by `b` in `x/y.py`": [("b", "CALLS", "a")],
             "`A` extends `B` and `C` imports `D`": [("C", "IMPORTS", "D"), ("A", "INHERITS", "B")], "`a` uses `b`": []}
    got = column(spark, list(cases), A.relation_triples)
    assert [[(t.subject, t.relation, t.object) for t in rows] for rows in got] == list(cases.values())


def test_a_marker_character_is_text(spark):
    assert column(spark, ["One\x01 two. Three\x01."], A.sentences) == [["One\x01 two.", "Three\x01."]]


@pytest.mark.parametrize("size", [1, 4, 9, 1000])
def test_chunked_answers_equal_whole_answers(spark, size):
    """Every fourth chunk comes after the next one, and every third comes twice."""
    texts = {"a": ANSWER, "b": "No. 5 is e.g. fine!? Yes. [C1] [C2] ``` x. y", "c": " \n "}
    rows = [(k, i, t[j:j + size], j + size >= len(t)) for k, t in texts.items() for i, j in enumerate(range(0, len(t), size))]
    schema = "answer_id string, chunk_no bigint, chunk string, final boolean"
    state, events = spark.createDataFrame([], validator.STATE), None
    step = max(1, len(rows) // 5)
    order = sorted(rows, key=lambda r: (r[1] + (1.5 if r[1] % 4 == 3 else 0), r[0]))
    for version, at in enumerate(range(0, len(order), step)):
        batch = order[at:at + step] + [r for r in order[max(0, at - 3):at] if not r[3]]
        told, state = validator.advance(state, spark.createDataFrame(batch, schema), version)
        told, state = told.cache(), state.cache()
        events = told if events is None else events.unionByName(told)
    assert state.isEmpty()
    found = {(r["answer_id"], r["sentence_no"]): r["text"] for r in validator.settled(events).collect()}
    whole = dict(zip(texts, column(spark, list(texts.values()), A.sentences)))
    assert found == {(k, i): s for k, own in whole.items() for i, s in enumerate(own)}


def test_a_silent_answer_ends(spark):
    schema = "answer_id string, chunk_no bigint, chunk string, final boolean"
    _, state = validator.advance(spark.createDataFrame([], validator.STATE), spark.createDataFrame([("a", 0, "An open end", False)], schema), 0)
    state = spark.createDataFrame(state.collect(), validator.STATE)
    assert validator.advance(state, spark.createDataFrame([], schema), 1, "1 hour")[0].isEmpty()
    old = state.withColumn("seen", F.col("seen") - F.expr("interval 2 hours"))
    events, rest = validator.advance(old, spark.createDataFrame([], schema), 1, "1 hour")
    assert [r["text"] for r in events.collect()] == ["An open end"] and rest.isEmpty()


def test_streamed_saves(spark, tmp_path):
    from symtrail.engine import CodeGraph
    from symtrail.streaming import indexing

    rows = [("r", "a.py", b"def old(): pass\n", 1, 1), ("r", "a.py", b"def new(): pass\n", 2, 2), ("r", "b.py", b"from a import new\n\n\ndef go():\n    new()\n", 2, 3)]
    df = spark.createDataFrame([(r, p, bytearray(c), t, s) for r, p, c, t, s in rows], "repo_id string, rel_path string, content binary, t bigint, seq bigint")
    df.withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(str(tmp_path / "in"))
    engine = CodeGraph(spark, str(tmp_path / "graph"))
    saves = spark.readStream.schema(indexing.SAVES).parquet(str(tmp_path / "in"))
    indexing.start(engine, saves, str(tmp_path / "cp"), interval=None).awaitTermination()
    graph = engine.store.read()
    assert {r.qualified_name for r in graph.symbols.collect()} == {"a", "a.new", "b", "b.go"}
    assert graph.edges.filter("kind = 'CALLS'").count() == 1


def test_cited_names_are_looked_up_in_the_cited_blocks_only(spark):
    from symtrail.operators import grounding as GR

    answers = spark.createDataFrame([
        ("a", "It calls `one` and `two` [C1][C2]. Then `two` runs [C1]. Nothing is cited by `one`."), ("b", "The `Shop.one` class sells [C9]."),
        ("c", "No. `one` sells [C1]! ~~~\n. `gone` [C1]\n~~~ The `x.one.` method ends [C1]. Plain words [C1].")], "answer_id string, text string")
    blocks = spark.createDataFrame([("a", "C1", "def one(): pass"), ("a", "C2", "two"), ("a", None, "two"), ("b", "C1", "Shop one"), ("c", "C1", "one")],
                                   "answer_id string, handle string, text string")
    out = GR.unsupported(GR.sentences(answers), blocks)
    assert sorted((r.answer_id, r.sentence_no, r.missing) for r in out.collect()) == [("a", 1, ["two"]), ("c", 2, ["x.one"])]
    # Sentences and blocks are dealt by answer once, and a sentence is judged in one place.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1


def test_a_plain_word_comes_before_every_verb(spark):
    spoken = {"calls": "CALLS", "invokes": "CALLS", "is called by": None, "is  invoked from": None, "imports": "IMPORTS", "defines": "DEFINES", "is defined in": None,
              "dispatches to": "DISPATCHES_TO", "routes to": "DISPATCHES_TO", "inherits from": "INHERITS", "extends": "INHERITS", "is a subclass of": "INHERITS"}
    turned = {"is called by": "CALLS", "is  invoked from": "CALLS", "is defined in": "DEFINES"}
    found = column(spark, [f"`a.b` method of `C` {verb} the `d` class in `x/y.py`." for verb in spoken], A.relation_triples)
    assert [[tuple(t) for t in ts] for ts in found] == [
        [("C.a.b", kind, "d") if kind else ("d", turned[verb], "C.a.b")] for verb, kind in spoken.items()]
    assert all(any(w in verb for words in A.VERB_WORDS for w in words) for verb in spoken)


def test_a_report_judges_its_sentences_once(spark):
    from symtrail.plans.catalog import QUERIES, load
    load()
    report = QUERIES["grounding_report"](spark, "/root/testdata/sf0.001")
    assert "regexp_extract_all" not in report._jdf.queryExecution().executedPlan().toString()
