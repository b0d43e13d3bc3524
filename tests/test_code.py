"""Parsing, resolution and questions on the small projects."""

import ast
import gc
import itertools
import random

import pytest
from pyspark.sql import functions as F

from symtrail.engine import CodeGraph
from symtrail.operators import mro, resolve as R
from symtrail.sources import parse
from tests.projects import as_files


@pytest.fixture(scope="module")
def parsed(spark, shop_files):
    facts = parse.facts(shop_files).cache()
    return parse.symbols(facts).cache(), parse.raw_edges(facts).cache()


@pytest.fixture(scope="module")
def resolved(parsed):
    symbols, raw = parsed
    names = symbols.select("uid", "qualified_name")
    edges = R.resolve(raw, symbols).edges
    rows = edges.join(names.toDF("src", "s"), "src").join(names.toDF("tgt", "t"), "tgt").select("kind", "s", "t").collect()
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def engine(spark, shop_files, tmp_path_factory):
    graph = CodeGraph(spark, str(tmp_path_factory.mktemp("graph")))
    graph.sync(shop_files)
    return graph


def test_python_symbols(parsed):
    rows = {(r.qualified_name, r.arity, r.ordinal): r for r in parsed[0].filter("repo_id = 'dj'").collect()}
    assert ("authx", 0, 0) in rows and ("broken", 0, 0) in rows
    assert ("broken.half", 0, 0) not in rows                     # a file that does not parse keeps its module only
    assert {o for q, a, o in rows if q == "authx.services.clock_skew_seconds"} == {0, 1}
    assert ("billing.tasks.charge_card", 3, 0) in rows           # keyword-only counts
    assert ("authx.views.LoginView.post", 1, 0) in rows          # self does not
    post = rows["authx.views.LoginView.post", 1, 0]
    assert post.enclosing_signature == "class LoginView(APIView):"
    assert ".services.issue_token" in post.used_imports and ".models.ApiToken" not in post.used_imports
    sub = rows["billing.models.Subscription", 0, 0]
    assert sub.bases == ["common.mixins.TimestampMixin", "common.mixins.SoftDeleteMixin"]


def test_typescript_symbols(parsed):
    rows = {(r.qualified_name, r.arity, r.ordinal): r for r in parsed[0].filter("repo_id = 'nx'").collect()}
    route = "app.api.users.route."
    assert {(route + "GET", 1, 0), (route + "parse", 1, 0), (route + "parse", 1, 1), (route + "parse", 1, 2),
            (route + "join", 0, 0), (route + "withDefault", 2, 0), ("components.Card.Card", 1, 0),
            ("components.Card.CardError", 0, 0), ("components.Card.CardError.describe", 0, 0)} <= set(rows)
    assert "Reads one user." in rows[route + "GET", 1, 0].docstring
    assert rows["components.Card.Card", 1, 0].is_client_component
    assert not rows[route + "GET", 1, 0].is_client_component
    # A callback bound through a hook is no declaration.
    assert not any(q.endswith(".go") for q, _, _ in rows)


def test_edges(resolved):
    want = {
        ("CALLS", "authx.views.LoginView.post", "authx.services.issue_token"),
        ("CALLS", "authx.services.revoke_all", "authx.models.ApiToken"),
        ("CALLS", "billing.models.Subscription.cancel", "common.mixins.SoftDeleteMixin.soft_delete"),
        ("INHERITS", "authx.models.User", "common.mixins.TimestampMixin"),
        ("HAS_FIELD", "authx.models.ApiToken", "authx.models.User"),
        ("USES_SERIALIZER", "authx.views.LoginView", "authx.serializers.LoginSerializer"),
        ("USES_SERIALIZER", "authx.views.LoginView.post", "authx.serializers.LoginSerializer"),
        ("DISPATCHES_TO", "authx.urls", "authx.views.LoginView"),
        ("IMPORTS", "authx.views", "common.utils.mask_email"),
        ("DEFINES", "authx.views.LoginView", "authx.views.LoginView.post"),
        ("CALLS", "app.api.users.route.GET", "lib.users.getUserById"),
        ("CALLS", "components.Card.CardError.constructor", "components.Base.Base.constructor"),
        ("CALLS", "components.Card.CardError.describe", "components.Base.Base.render"),
        ("CALLS", "components.Card.CardError.describe", "components.Card.CardError.label"),
        ("OVERRIDES", "components.Card.CardError.constructor", "components.Base.Base.constructor"),
        ("DISPATCHES_TO", "app.api.users.route", "app.api.users.route.GET"),
    }
    assert want <= resolved
    assert not any(k == "CALLS" and t.endswith(".revoke") for k, _, t in resolved)   # a loop variable has no type
    assert not any(s == t for _, s, t in resolved)


def test_hooks(parsed):
    hooks = {r.qualified_name: r.hooks for r in parse.hooks_invoked(parsed[1], parsed[0]).collect()}
    assert hooks == {"components.Card.Card": ["useCallback", "useState"]}


GOLDEN = {
    "what calls audit_event": {"authx.services.issue_token", "authx.views.LoginView.post", "authx.views.TokenRevokeView.delete",
                               "billing.tasks.charge_card", "billing.views.SubscriptionView.post"},
    "who calls charge_card": {"billing.tasks.run_monthly_billing", "billing.tasks.retry_failed", "billing.views.SubscriptionView.post"},
    "callers of constant_time_equals": {"authx.services.verify_credentials"},
    "where is chunked used": {"billing.tasks.run_monthly_billing", "billing.tasks"},
    "what does LoginView.post call": {"authx.serializers.LoginSerializer", "authx.services.verify_credentials", "common.utils.mask_email",
                                      "authx.services.issue_token", "common.utils.audit_event"},
    "where is issue_token defined": {"authx.services"},
    "subclasses of TimestampMixin": {"authx.models.User", "authx.models.ApiToken", "billing.models.Subscription"},
    "what imports common.utils": {"authx.services", "authx.views", "billing.tasks", "billing.views"},
    "callers of soft_delete": {"billing.models.Subscription.cancel"},
    "what eventually calls mask_email": {"authx.views.LoginView.post"},
}
TRACE = '''Traceback (most recent call last):
  File "/srv/app/billing/views.py", line 10, in post
    charge_card(request.user, 5)
  File "/srv/app/billing/tasks.py", line 8, in charge_card
    audit_event("charge")
ValueError: no card
'''


@pytest.fixture(scope="module")
def answered(spark, engine):
    asked = [(q, "dj", q) for q in GOLDEN] + [("trace", "dj", TRACE), ("lost", "dj", TRACE.replace("billing/", "other/").replace("charge_card", "nobody").replace("tasks.py", "gone.py").replace("in post", "in t1")),
                                              ("how", "dj", "how is an email address masked before it is logged"), ("many", "nx", "what calls GET"), ("none", "dj", "who calls nothing_here")]
    return engine.ask(spark.createDataFrame(asked, "question_id string, repo_id string, query string"), root=None)


def test_structural_questions(answered, engine):
    names = engine.store.read().symbols.select("uid", "qualified_name")
    got = {}
    for r in answered.related.join(names, "uid").collect():
        got.setdefault(r.question_id, set()).add(r.qualified_name)
    assert {q: got.get(q, set()) for q in GOLDEN} == GOLDEN


def test_trace_questions(answered, engine):
    names = {r.uid: r.qualified_name for r in engine.store.read().symbols.collect()}
    rows = {(r.question_id, r.frame_no): r for r in answered.frames.collect()}
    assert rows["trace", 0].tier == "direct" and names[rows["trace", 0].uid] == "billing.views.SubscriptionView.post"
    assert names[rows["trace", 1].uid] == "billing.tasks.charge_card" and rows["trace", 1].badge == "✓ direct"
    assert rows["lost", 0].tier == "unresolved" and rows["lost", 1].tier == "unresolved"
    first = answered.blocks.filter("question_id = 'trace' and role = 'seed'").orderBy(F.desc("score")).first()
    assert names[first.uid] == "billing.tasks.charge_card"       # innermost first


def test_semantic_and_refused_questions(answered, engine):
    names = {r.uid: r.qualified_name for r in engine.store.read().symbols.collect()}
    seeds = answered.blocks.filter("role = 'seed'").orderBy(F.desc("score")).collect()
    assert "common.utils.mask_email" in [names[r.uid] for r in seeds if r.question_id == "how"]
    verdicts = {r.question_id: r.verdict for r in answered.entities.collect()}
    assert verdicts["many"] == "ambiguous" and verdicts["none"] == "unresolved"
    routes = {r.question_id: r.route_taken for r in answered.routed.collect()}
    assert routes["many"] == "SEMANTIC" and routes["trace"] == "TRACE" and routes["who calls charge_card"] == "STRUCTURAL"


def test_a_poor_answer_is_packed_again_once(spark, engine, answered):
    asked = "who calls charge_card"
    told = [(asked, "`common.utils.mask_email` calls `billing.tasks.charge_card` [C1]."), ("where is issue_token defined", "It is defined in `authx.services` [C1].")]
    answers = spark.createDataFrame(told, "question_id string, text string")
    again = engine.retry(answered, answers)
    report = {r["question_id"]: r for r in again.report.collect()}
    assert report[asked]["conflicts"] == 1 and report[asked]["retry"] and not report["where is issue_token defined"]["retry"]
    first = answered.packed.filter(F.col("question_id") == asked).collect()
    cited = next(r["uid"] for r in first if r["handle"] == "C1")
    dropped = {r["uid"] for r in first if r["handle"] is None}
    plan = {(r["question_id"], r["action"], r["uid"]) for r in again.plan.collect()}
    assert plan == ({(asked, "promote", u) for u in dropped} if dropped else {(asked, "expand", cited)})
    second = [r for r in again.packed.collect() if r["handle"]]
    assert second and {r["question_id"] for r in second} == {asked}
    shown = {r["uid"] for r in first if r["handle"]}
    assert {r["uid"] for r in again.delta.collect()} == {r["uid"] for r in second} - shown
    assert engine.retry(answered, answers, retries=1).plan.count() == 0


def test_packed_answers(answered):
    rows = answered.packed.collect()
    per = {}
    for r in rows:
        if r.handle:
            per.setdefault(r.question_id, []).append((int(r.handle[1:]), r.cost))
    for handles in per.values():
        assert sorted(h for h, _ in handles) == list(range(1, len(handles) + 1))
        assert sum(c for _, c in handles) <= 21_200
    assert not any("s3cr3t" in (r.text or "") for r in rows)


# -- maintenance -------------------------------------------------------------------------------------

def edges_by_name(engine):
    g = engine.store.read()
    names = g.symbols.select("uid", "qualified_name")
    return {tuple(r) for r in g.edges.join(names.toDF("src", "s"), "src").join(names.toDF("tgt", "t"), "tgt").select("kind", "s", "t").collect()}


def test_incremental_writes(spark, tmp_path, shop_files):
    engine = CodeGraph(spark, str(tmp_path))
    engine.sync(shop_files)
    before = edges_by_name(engine)
    assert engine.reconcile(shop_files).changes.isEmpty()         # nothing changed, nothing written
    # A changed signature is a new uid; callers elsewhere must be linked again.
    new = as_files(spark).filter("rel_path = 'common/utils.py'").withColumn(
        "content", F.replace(F.col("content").cast("string"), F.lit("def mask_email(email)"), F.lit("def mask_email(email, style)")).cast("binary"))
    tree = as_files(spark).filter("rel_path <> 'common/utils.py'").unionByName(new)
    engine.write(new, tree=tree)
    assert edges_by_name(engine) == before
    g = engine.store.read()
    assert g.symbols.filter("name = 'mask_email'").select("arity").collect()[0].arity == 2
    assert g.symbols.filter("degree is null").isEmpty()
    # A move keeps inbound edges.
    moved = new.withColumn("rel_path", F.lit("common/helpers.py"))
    moves = spark.createDataFrame([("dj", "common/utils.py", "common/helpers.py")], "repo_id string, old_path string, new_path string")
    engine.write(moved, moves=moves)
    after = edges_by_name(engine)
    assert ("CALLS", "authx.views.LoginView.post", "common.helpers.mask_email") in after
    assert engine.store.read().files.filter("rel_path = 'common/utils.py'").isEmpty()
    # A crash before the commit marker leaves the previous snapshot in place; a replay converges.
    gone = tree.filter("rel_path = 'billing/views.py'")
    with pytest.raises(RuntimeError):
        engine.write(spark.createDataFrame([], gone.schema), deleted=gone, epoch=engine.next_epoch(), stop_after="symbols")
    assert edges_by_name(engine) == after
    engine.write(spark.createDataFrame([], gone.schema), deleted=gone)
    assert engine.store.read().symbols.filter("rel_path = 'billing/views.py'").isEmpty()


def sources(spark, *rows):
    return spark.createDataFrame([(r, p, bytearray(t.encode())) for r, p, t in rows], "repo_id string, rel_path string, content binary")


def test_a_rename_without_a_save_keeps_the_file(spark, tmp_path):
    engine = CodeGraph(spark, str(tmp_path))
    used, user = ("r", "a.py", "def two():\n    pass\n"), ("r", "b.py", "from a import two\n\n\ndef go():\n    two()\n")
    engine.sync(sources(spark, used, user))
    assert ("CALLS", "b.go", "a.two") in edges_by_name(engine)
    nothing = sources(spark).limit(0)
    move = lambda new: spark.createDataFrame([("r", "a.py", new)], "repo_id string, old_path string, new_path string")
    engine.write(nothing, moves=move("lost.py"))                       # what it holds is unknown
    assert {r.rel_path for r in engine.store.read().files.collect()} == {"a.py", "b.py"}
    tree = sources(spark, ("r", "c.py", used[2]), user)
    engine.write(nothing, moves=move("c.py"), tree=tree)
    assert {r.rel_path for r in engine.store.read().files.collect()} == {"c.py", "b.py"}
    assert ("CALLS", "b.go", "c.two") in edges_by_name(engine)


def test_moves_of_two_repositories_in_one_stream(spark, tmp_path):
    from symtrail.streaming import indexing

    engine = CodeGraph(spark, str(tmp_path / "graph"))
    text = "def two():\n    pass\n"
    engine.sync(sources(spark, ("r", "a.py", text), ("s", "a.py", text)))
    rows = [("r", "c.py", None, 1, "a.py"), ("s", "d.py", bytearray(text.encode()), 2, "a.py")]
    batch = spark.createDataFrame(rows, "repo_id string, rel_path string, content binary, seq bigint, old_path string")
    batch.withColumn("ts", F.timestamp_seconds("seq")).select(*[c.split()[0] for c in indexing.SAVES.split(", ")]).write.parquet(str(tmp_path / "in"))
    saves = spark.readStream.schema(indexing.SAVES).parquet(str(tmp_path / "in"))
    tree = sources(spark, ("r", "c.py", text), ("s", "d.py", text))
    indexing.start(engine, saves, str(tmp_path / "cp"), interval=None, tree=tree).awaitTermination()
    assert {(r.repo_id, r.rel_path) for r in engine.store.read().files.collect()} == {("r", "c.py"), ("s", "d.py")}


def test_questions_stay_in_their_repository(spark, tmp_path):
    engine = CodeGraph(spark, str(tmp_path))
    engine.sync(sources(spark, ("r1", "a.py", "def helper():\n    pass\n"), ("r2", "b.py", "def two():\n    helper()\n\n\ndef helper():\n    pass\n")))
    asked = spark.createDataFrame([("q1", "r1", "who calls `two`"), ("q2", "r1", "who calls `helper`"), ("q3", "r2", "who calls `helper`")], "question_id string, repo_id string, query string")
    answered = engine.ask(asked)
    verdicts = {r.question_id: r.verdict for r in answered.entities.collect()}
    assert verdicts == {"q1": "unresolved", "q2": "resolved", "q3": "resolved"}
    named = {r.uid: r.qualified_name for r in engine.store.read().symbols.collect()}
    assert {(r.question_id, named[r.uid]) for r in answered.related.collect()} == {("q3", "b.two")}


def test_a_write_leaves_other_repositories_files(spark, tmp_path, monkeypatch):
    from symtrail.sources import snapshots

    monkeypatch.setattr(snapshots, "MOST_EPOCHS", 3)
    engine = CodeGraph(spark, str(tmp_path))
    text = "def one():\n    pass\n"
    engine.sync(sources(spark, *[(r, "a.py", text) for r in ("r1", "r2", "r3")]))
    first = engine.store.current()
    kept = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("repo_id=r2/*.parquet")}
    second = engine.write(sources(spark, ("r1", "a.py", text + "\n\ndef two():\n    one()\n"))).epoch
    assert {r.repo_id: r["at"] for r in engine.store.manifest(second).collect()} == {"r1": second, "r2": first, "r3": first}
    assert kept and {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("repo_id=r2/*.parquet")} == kept
    assert ("CALLS", "a.two", "a.one") in edges_by_name(engine)
    third = engine.write(sources(spark, ("r2", "b.py", text))).epoch
    fourth = engine.write(sources(spark, ("r1", "b.py", text))).epoch     # gathers all, as three epochs are read
    assert engine.store.spread(third) == [first, second, third] and engine.store.spread(fourth) == [fourth]
    engine.write(sources(spark, ("r3", "c.py", text)))
    assert engine.store.epochs()[0] == fourth                             # what no snapshot reads is removed
    assert engine.store.read().files.count() == 6


def test_waiting_names(spark, tmp_path):
    engine = CodeGraph(spark, str(tmp_path))
    files = lambda *rows: spark.createDataFrame([("r", p, bytearray(t.encode())) for p, t in rows], "repo_id string, rel_path string, content binary")
    caller = ("a.py", "from b import later\n\n\ndef run():\n    later()\n")
    engine.sync(files(caller))
    assert engine.store.read().files.collect()[0].waiting == ["b.later"]
    added = ("b.py", "def later():\n    pass\n")
    engine.write(files(added), tree=files(caller, added))
    assert ("CALLS", "a.run", "b.later") in edges_by_name(engine)


# -- class orders -----------------------------------------------------------------------------------------

def test_class_orders_match_python(spark):
    rng = random.Random(5)
    made, rows = {}, []
    for i in range(60):
        bases = rng.sample(sorted(made), min(len(made), rng.choice([0, 1, 2, 2, 3])))
        try:
            cls = type(f"C{i:02d}", tuple(made[b] for b in bases) or (object,), {})
            expected = [c.__name__ for c in cls.__mro__ if c is not object]
            made[f"C{i:02d}"] = cls
        except TypeError:
            expected = None
        rows.append((f"C{i:02d}", bases, expected))
    rows += [("Loop1", ["Loop2"], None), ("Loop2", ["Loop1"], None), ("Ext", ["lib.Base"], ["Ext", "lib.Base"])]
    symbols = spark.createDataFrame([("r", n, n, "class", b, {}) for n, b, _ in rows],
                                    "repo_id string, qualified_name string, uid string, kind string, bases array<string>, attributes map<string,string>")
    got = {r.cls: r.order for r in mro.class_orders(mro.known_classes(symbols)).collect()}
    assert got == {n: e for n, _, e in rows}


def test_member_outcomes(spark):
    def sym(q, kind="function", bases=(), uid=None):
        return ("r", q, uid or q, kind, list(bases), {})
    symbols = spark.createDataFrame([
        sym("B", "class"), sym("B.m"), sym("C", "class", ["B"]), sym("D", "class", ["C", "B"]),
        sym("L", "class", ["lib.X", "B"]), sym("E", "class", ["B", "lib.X"]), sym("T", "class"), sym("T", "class", uid="T2"),
        sym("U", "class", ["T"]), sym("A", "class"), sym("A.m"), sym("A.m", uid="A.m2")],
        "repo_id string, qualified_name string, uid string, kind string, bases array<string>, attributes map<string,string>")
    classes = mro.known_classes(symbols)
    orders = mro.class_orders(classes)
    wanted = spark.createDataFrame([("r", c, m, s) for c, m, s in (
        ("D", "m", 0), ("L", "m", 0), ("E", "m", 0), ("E", "z", 0), ("U", "m", 0), ("A", "m", 0), ("B", "m", 1), ("T", "m", 0))],
        "repo_id string, cls string, method string, skip int")
    got = {(r.cls, r.method): (r.outcome, r.target_uid) for r in mro.lookups(wanted, mro.walkable(orders, classes), orders, symbols).collect()}
    assert got == {("D", "m"): ("resolved", "B.m"), ("L", "m"): ("uncertain", None), ("E", "m"): ("resolved", "B.m"), ("E", "z"): ("uncertain", None),
                   ("U", "m"): ("uncertain", None), ("A", "m"): ("ambiguous", None), ("B", "m"): ("absent", None), ("T", "m"): ("not_a_class", None)}


def test_prefix_refusals(spark):
    symbols = spark.createDataFrame([("r", "p", "m0", "module", 1), ("r", "p.f", "f1", "function", 1), ("r", "p.g", "g1", "function", 1), ("r", "p.g", "g2", "function", 1)],
                                    "repo_id string, qualified_name string, uid string, kind string, epoch int")
    hints = spark.createDataFrame([("r", h, e) for h, e in (("p.f.cache", False), ("p.g", False), ("p.h", False), ("p", False), ("p.f.x", True), ("..p", False))],
                                  "repo_id string, target_hint string, exact boolean")
    got = {(r.target_hint, r.exact): (r.outcome, r.found) for r in R.by_prefix(hints, symbols).collect()}
    assert got == {("p.f.cache", False): ("resolved", "f1"), ("p.g", False): ("ambiguous", None), ("p.h", False): ("unresolved", None), ("p", False): ("resolved", "m0")}


def test_parse_tasks_follow_the_number_of_files(spark, monkeypatch):
    files = spark.range(60).select(F.lit("r").alias("repo_id"), F.concat(F.lit("m"), "id", F.lit(".py")).alias("rel_path"),
                                   F.lit("def run(a):\n    return a\n").cast("binary").alias("content")).coalesce(1)
    monkeypatch.setattr(parse, "FILES_PER_TASK", 2)
    facts = parse.facts(files)
    assert facts.rdd.getNumPartitions() == 30
    assert facts.count() == 60 and {d["name"] for r in facts.collect() for d in r["defs"]} == {"run"}


def test_members_and_overrides_are_looked_up_once(spark, parsed, monkeypatch):
    calls, lookups = [], mro.lookups
    monkeypatch.setattr(mro, "lookups", lambda *args: calls.append(1) or lookups(*args))
    R.resolve(parsed[1], parsed[0])
    assert len(calls) == 1


def test_a_syntax_tree_goes_when_its_file_is_read():
    from symtrail.sources import python_facts
    gc.collect()
    gc.disable()
    try:
        python_facts.extract("import a\nclass C(a.B):\n    def f(self):\n        return self.g(1 + 2)\n")
        assert not [x for x in gc.get_objects() if isinstance(x, ast.FunctionDef)]
    finally:
        gc.enable()
