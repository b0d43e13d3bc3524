"""Outcomes, gates, exact ranks, samples and retries against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from symtrail.operators import metrics as ME, outcomes as O


def brute_rank(values, fraction):
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    return ordered[max(0, min(len(ordered) - 1, round(fraction * len(ordered) + 0.5) - 1))]


@pytest.mark.parametrize("few", [0, 10, 65_536])
def test_rank_values(spark, few):
    rng = random.Random(3)
    values = {
        "even": [rng.random() for _ in range(500)], "same": [2.5] * 300, "ties": [float(rng.randrange(4)) for _ in range(301)],
        "wide": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)], "one": [-7.25], "zero": [0.0, -0.0, 1e-320, -1e-320],
        "odd": [float("nan"), float("inf"), float("-inf"), 1.0, 2.0, float("nan")], "near": [1.0 + k * 2.0 ** -52 for k in range(200)], None: [5.0, 6.0],
    }
    rows = [(k, v) for k, vs in values.items() for v in [*vs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, v double")
    fractions = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r["key"], r["fraction"]): r["v"] for r in ME.rank_values(df, ["key"], "v", fractions, few=few).collect()}
    assert len(got) == len(values) * len(fractions)
    for k, vs in values.items():
        for f in fractions:
            want = brute_rank(vs, f)
            assert got[k, f] == want or (math.isnan(got[k, f]) and math.isnan(want)), (k, f)


def test_rank_values_without_keys_and_without_rows(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("int").alias("v"))
    assert {(r["fraction"], r["v"]) for r in ME.rank_values(df, [], "v", [0.5, 0.95], few=5).collect()} == {(0.5, brute_rank(range(1, 1001), 0.5)), (0.95, brute_rank(range(1, 1001), 0.95))}
    assert ME.rank_values(df.filter("v < 0"), [], "v", [0.5]).count() == 0


def test_seeded_sample(spark, monkeypatch):
    monkeypatch.setattr(ME, "DIGITS", 1)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 40, "b").otherwise(None).alias("kind"), F.lit("x").alias("_t"))
    whole = ME.seeded_sample(df.drop("_t"), 100, [F.col("id")], 7)
    ids = {r["id"] for r in whole.collect()}
    assert len(ids) == 100 and whole.columns == ["id", "kind"]
    assert ids == {r["id"] for r in ME.seeded_sample(df.drop("_t").repartition(7), 100, [F.col("id")], 7).collect()}
    assert ids != {r["id"] for r in ME.seeded_sample(df.drop("_t"), 100, [F.col("id")], 8).collect()}
    # A smaller sample is part of a larger one, and a sample of parts is that of the whole.
    assert {r["id"] for r in ME.seeded_sample(df.drop("_t"), 30, [F.col("id")], 7).collect()} < ids
    parts = [ME.seeded_sample(df.drop("_t").filter(F.col("id") % 2 == k), 100, [F.col("id")], 7) for k in (0, 1)]
    assert {r["id"] for r in ME.seeded_sample(parts[0].unionByName(parts[1]), 100, [F.col("id")], 7).collect()} == ids
    by = ME.seeded_sample(df.drop("_t"), 50, [F.col("id")], 7, ["kind"]).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in by} == {"a": 50, "b": 26, None: 50}
    twice = df.drop("_t").unionByName(df.drop("_t"))
    assert ME.seeded_sample(twice, 7, [F.col("id")], 1).count() == 8      # the last key's repeat comes along
    assert ME.seeded_sample(df.drop("_t").limit(0), 5, [F.col("id")]).count() == 0


def outcomes_of(spark):
    questions = spark.createDataFrame([("q1", "TRACE", "typescript"), ("q2", "TRACE", "python"), ("q3", "SEMANTIC", "python"), ("q4", None, "python")], "question_id string, class string, language string")
    packed = spark.createDataFrame([("q1", "u1", "C1", 1, 10), ("q1", "u2", "C2", 2, 5), ("q1", "u3", None, 3, 0), ("q2", "u1", "C1", 1, 7)],
                                   "question_id string, uid string, handle string, rank int, cost bigint")
    gold = spark.createDataFrame([("q1", "u2"), ("q1", "u3"), ("q2", "u9")], "question_id string, uid string")
    report = spark.createDataFrame([("q1", 4, 3, 2, 1, 1, 0.75), ("q2", 2, 1, 0, 0, 0, 0.5)], "question_id string, claims long, cited long, relations long, verified long, conflicts long, coverage double")
    frames = spark.createDataFrame([("q1", "typescript", "a.ts", "direct"), ("q1", "typescript", "b.ts", "name"), ("q1", "typescript", "c.ts", "unresolved"),
                                    ("q1", "typescript", "node_modules/x/d.ts", "direct"), ("q2", "python", "a.py", "direct")], "question_id string, language string, file_path string, tier string")
    costs = spark.createDataFrame([("q1", 0.5, 1.0, True), ("q2", 0.25, 3.0, True)], "question_id string, usd double, ttft double, retried boolean")
    errors = spark.createDataFrame([("q1",), ("q1",)], "question_id string")
    return O.question_outcomes(questions, packed, gold, report, frames, errors, None, costs)


def test_question_outcomes(spark):
    rows = {r["question_id"]: r.asDict() for r in outcomes_of(spark).collect()}
    assert len(rows) == 4
    q1 = rows["q1"]
    assert (q1["packed_tokens"], q1["gold_rank"], q1["frames_total"], q1["frames_resolved"], q1["unknown_citations"], q1["answered"], q1["needs_review"]) == (15, 2, 3, 2, 2, True, True)
    assert rows["q2"]["gold_rank"] is None and rows["q2"]["frames_total"] == 0 and rows["q2"]["needs_review"]
    assert not rows["q3"]["answered"] and rows["q3"]["claims"] == 0 and not rows["q4"]["retried"]


def test_rollup_in_one_pass(spark):
    rolled = O.rollup(outcomes_of(spark))
    rows = {(r["level"], r["class"], r["language"]): r for r in rolled.collect()}
    assert len(rows) == 4 + 3 + 2 + 1
    whole = rows["all", None, None]
    assert (whole["questions"], whole["answered"], whole["claims"], whole["cited"]) == (4, 2, 6, 4) and whole["coverage"] == 4 / 6
    assert whole["frame_resolution"] == 2 / 3 and rows["language", None, "python"]["frame_resolution"] is None
    assert rows["class", None, None]["questions"] == 1 and rows["class", "TRACE", None]["relation_precision"] == 0.5
    assert rows["class", "SEMANTIC", None]["coverage"] is None
    plan = rolled._jdf.queryExecution().toString()
    assert plan.count("Expand [") >= 1


def test_measures_and_partitions(spark):
    values = {r["name"]: r["value"] for r in O.measures(outcomes_of(spark)).collect()}
    assert values == {"Citation Coverage": 4 / 6, "Relation Precision": 0.5, "TTFT p50": 3.0, "TTFT p95": 3.0, "$/query p50 (uncached)": 0.5, "$/query p95 (uncached)": 0.5}
    gates = ME.gates(O.measures(outcomes_of(spark)))
    parts = {r["status"]: (r["n"], r["names"]) for r in O.gate_partitions(gates).collect()}
    assert parts["PASS"] == (0, "") and parts["FAIL"][0] == 6 and parts["NOT MEASURED"][0] == 7
    assert parts["FAIL"][1].startswith("Citation Coverage; Relation Precision; TTFT p50; TTFT p95")
    empty = {r["status"]: r["n"] for r in O.gate_partitions(gates.limit(0)).collect()}
    assert empty == {"PASS": 0, "FAIL": 0, "NOT MEASURED": 0}


# -- counters, records, retries ----------------------------------------------------------------------------

def test_counters_ride_on_the_write(spark):
    from symtrail.counters import Counters, rows
    from symtrail.session import cut

    counters = Counters()
    df = cut(counters.watch(spark.range(100).repartition(5), {"seen": F.count(F.lit(1)), "odd": F.count_if(F.col("id") % 2 == 1), "none": F.count_if(F.col("id") < 0)}))
    df.count(), df.count()                                   # later reads count nothing again
    cut(counters.watch(spark.range(7), {"seen": F.count(F.lit(1))}))
    counters.add("told", 2)
    counters.add("told")
    assert counters.values() == {"seen": 107, "odd": 50, "told": 3} == counters.values()
    made = rows(spark, {"move.undetected": 2, "move.total": 10})
    got = {r["name"]: (r["value"], r["fires"]) for r in ME.decisions(made).collect()}
    assert got["Undetected-move rate"] == (0.2, True) and got["Header-only miss share"] == (None, None)


def kv(spark, **values):
    return spark.createDataFrame(list(values.items()), "key string, value string")


def test_meta_versions_and_conflicts(spark, tmp_path, monkeypatch):
    from symtrail.sources import meta as MT

    monkeypatch.setattr(MT, "MOST_VERSIONS", 3)
    table = MT.Meta(spark, str(tmp_path))
    read = lambda at=None: dict(tuple(r) for r in table.read(at).collect())
    assert table.version() == 0 and read() == {}
    first = table.put(kv(spark, a="1", b="1"))
    assert table.put(kv(spark, b="2"), based_on=first) == 2 and read() == {"a": "1", "b": "2"} and read(1) == {"a": "1", "b": "1"}
    with pytest.raises(MT.Conflict, match="b"):
        table.put(kv(spark, a="9", b="9"), based_on=first)
    assert read() == {"a": "1", "b": "2"}                     # all keys or none
    assert table.put(kv(spark, a="3"), based_on=first) == 3   # another key: no conflict
    for k in range(6):
        table.put(kv(spark, c=str(k)))
    assert read() == {"a": "3", "b": "2", "c": "5"} and any(table._commit(n)["whole"] for n in table.versions())
    # A writer that lost the race looks again and takes the next number.
    claim, lost = table._claim, []

    def late(number, content):
        if not lost:
            lost.append(number)
            assert claim(number, {**content, "rows": content["rows"]})
            return False
        return claim(number, content)

    monkeypatch.setattr(table, "_claim", late)
    monkeypatch.setattr(MT, "folder_of", lambda s, p, real=MT.folder_of: real(s, p))
    before = table.version()
    fs_delete = []
    real_path = table._path
    monkeypatch.setattr(table, "_path", lambda name: (type("Fs", (), {"delete": lambda self, *a: fs_delete.append(name)})(), None) if name.startswith("rows/") else real_path(name))
    assert table.put(kv(spark, a="4")) == before + 2 and fs_delete


def test_embedder_gate_and_bootstrap(spark):
    from types import SimpleNamespace

    from symtrail.operators import embedding

    repos = spark.createDataFrame([("same",), ("other",), ("never",)], "repo_id string")
    meta = kv(spark, **{"index_embed_model:same": "m", "index_embed_model:other": "old"})
    gate = lambda provider: {r["repo_id"]: (r["usable"], r["reason"]) for r in embedding.vector_gate(repos, meta, provider).collect()}
    model = SimpleNamespace(name="m", semantic=True, local=True)
    got = gate(model)
    assert got["same"] == (True, "") and not got["other"][0] and "old" in got["other"][1] and "no embedding model" in got["never"][1]
    assert set(gate(embedding.HashProvider(name="m")).values()) == {(False, "no embedding model is configured")}
    known = repos.filter("repo_id <> 'never'")
    plan = lambda provider: {r["repo_id"]: r["action"] for r in embedding.bootstrap_decision(repos, known, meta, provider).collect()}
    assert plan(model) == {"same": "reconcile", "other": "reembed", "never": "index"}
    assert plan(SimpleNamespace(name="m", semantic=True, local=False)) == {"same": "reconcile", "other": "reconcile", "never": "index"}
    assert plan(embedding.DisabledProvider()) == {"same": "reconcile", "other": "reconcile", "never": "index"}


def test_a_bootstrap_embeds_again_what_another_model_wrote(spark, shop_files, tmp_path):
    from symtrail.engine import CodeGraph
    from symtrail.operators.embedding import BatchProvider

    calls = spark.sparkContext.accumulator(0)

    def model(name, n):
        def embed(texts):
            calls.add(len(texts))
            return [[float(n), float(len(t))] for t in texts]
        return BatchProvider(embed, 2, name)

    files = shop_files.filter(F.col("rel_path").endswith(".py")).limit(4).withColumn("repo_id", F.lit("a"))
    both = files.unionByName(files.withColumn("repo_id", F.lit("b"))).cache()
    graph = CodeGraph(spark, str(tmp_path / "store"), model("one", 1))
    plan, reports = graph.bootstrap(both)
    assert {r["repo_id"]: r["action"] for r in plan.collect()} == {"a": "index", "b": "index"}
    counters = reports[0].counters
    assert counters["index.files"] == both.count() and counters["cache.lookups"] == counters.get("cache.hits", 0) + counters["cache.miss.total"]
    assert counters["edge.resolved"] > 0 and "index.embedding_unavailable" not in counters
    vectors = lambda: {r["repo_id"]: r["v"] for r in graph.store.read().symbols.groupBy("repo_id").agg(F.collect_set(F.col("code_vec")[0]).alias("v")).collect()}
    assert vectors() == {"a": [1.0], "b": [1.0]}
    graph.provider = model("two", 2)
    # An incremental write adds no vectors of another model.
    one = both.filter("repo_id = 'a'").limit(1).withColumn("content", F.concat("content", F.lit("\n\ndef fresh_one():\n    return 1\n").cast("binary")))
    graph.write(one)
    added = graph.store.read().symbols.filter("name = 'fresh_one'").collect()
    assert len(added) == 1 and added[0]["code_vec"] is None
    calls.value = 0
    plan, reports = graph.bootstrap(both)
    assert {r["repo_id"]: r["action"] for r in plan.collect()} == {"a": "reembed", "b": "reembed"}
    assert vectors() == {"a": [2.0], "b": [2.0]} and calls.value > 0
    # Now the index is the model's own: nothing is embedded again.
    calls.value = 0
    plan, _ = graph.bootstrap(both)
    assert {r["action"] for r in plan.collect()} == {"reconcile"} and calls.value == 0
    assert graph.store.read().symbols.filter("repo_id = 'b'").count() > 0


def test_repacking_equals_packing_again(spark):
    from symtrail.operators import packing, retries as RY

    body = lambda n: "def f():\n" + "\n".join(f"    x{k} = {k}" for k in range(n))
    rows = [("q", f"u{k:02d}", "seed" if k < 6 else "neighbor", 10.0 - k, "a/b.py", None, f"def f{k}()", "Does a thing.", body(40 + 30 * k), []) for k in range(12)]
    rows += [("p", "u01", "seed", 1.0, "a/b.py", None, "def g()", None, body(5), [])]
    shape = "question_id string, uid string, role string, score double, rel_path string, enclosing_signature string, signature string, docstring string, source_code string, used_imports array<string>"
    blocks = spark.createDataFrame(rows, shape)
    ready = packing.rendered(blocks, packing.per_seed(1200))
    first = packing.fold(ready, 1200)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(first) == key(packing.pack(blocks, 1200))
    dropped = first.filter("handle is null").select("question_id", "uid")
    assert dropped.count() > 0
    plan = dropped.withColumn("action", F.lit("promote"))
    again = RY.second_blocks(blocks, plan)
    second = RY.repack(ready, again, 1200)
    assert key(second) == key(packing.pack(again, 1200)) and {r["question_id"] for r in second.collect()} == {"q"}
    shown = lambda df: {(r["question_id"], r["uid"]) for r in df.filter("handle is not null").collect()}
    assert {(r["question_id"], r["uid"]) for r in RY.delta(first, second).collect()} == shown(second) - shown(first) and shown(second) - shown(first)
    # Widening: new neighbours come in, those held keep their scores.
    wide = spark.createDataFrame([("q", "u07", "neighbor", 99.0, *rows[7][4:]), ("q", "new", "neighbor", 0.5, *rows[0][4:])], shape)
    widened = RY.second_blocks(blocks, spark.createDataFrame([("q", "expand", "u00")], "question_id string, action string, uid string"), wide)
    assert {(r["uid"], r["score"]) for r in widened.filter("uid in ('u07', 'new')").collect()} == {("u07", 3.0), ("new", 0.5)}
    assert key(RY.repack(ready, widened, 1200)) == key(packing.pack(widened, 1200))
