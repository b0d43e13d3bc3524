"""Operators against brute force on small data, including the paths for hot keys."""

import bisect
import math
import random

from pyspark.sql import functions as F

from symtrail import constants as C
from symtrail.functions import text as X, vectors as V
from symtrail.operators import graph as G, keyed, maintenance as M, metrics as ME, packing, retrieval as RT, sessions as S


def test_lookup_salts_hot_keys(spark):
    rng = random.Random(1)
    left = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(50)}") for i in range(600)]
    right = [("hot", "h"), ("hot", "h2")] + [(f"k{i}", f"v{i}") for i in range(25)]
    l = spark.createDataFrame(left, "i int, k string")
    r = spark.createDataFrame(right, "k string, v string")
    plain = sorted(map(tuple, l.join(r, "k", "left").collect()), key=str)
    salted = keyed.lookup(l, r, ["k"], hot_rows=50)
    assert sorted(map(tuple, salted.select("k", "i", "v").collect()), key=str) == plain
    assert keyed.lookup(l, r, ["k"], "inner", hot_rows=50).count() == l.join(r, "k").count()


def test_numbered_and_running_sums(spark):
    rows = [("a" if i % 4 else "b", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = {(r.k, r.i): (r.n, r.s) for r in keyed.running_sums(
        keyed.numbered(df, ["k"], F.floor(F.col("i") / 37), [F.col("i")], "n"), ["k"], F.floor(F.col("i") / 11), [F.col("i")], {"s": "v"}).collect()}
    for k in "ab":
        n = total = 0
        for kk, i, v in rows:
            if kk == k:
                n, total = n + 1, total + v
                assert got[k, i] == (n, total)


def test_as_of(spark):
    rng = random.Random(2)
    right = [("u", t, t * 10) for t in rng.sample(range(1000), 80)] + [("v", 500, 1)]
    left = [(rng.choice("uvw"), rng.randrange(1000), i) for i in range(300)]
    r = spark.createDataFrame(right, "k string, t int, v int")
    l = spark.createDataFrame(left, "k string, at int, i int")
    for strict in (False, True):
        got = {x.i: x.v for x in keyed.as_of(l, r, ["k"], "at", "t", ["v"], lambda c: F.floor(c / 64), strict=strict).collect()}
        for k, at, i in left:
            hits = [(t, v) for kk, t, v in right if kk == k and (t < at or (t == at and not strict))]
            assert got[i] == (max(hits)[1] if hits else None)


def test_innermost(spark):
    rng = random.Random(3)
    spans = []
    for i in range(150):
        a = rng.randrange(200)
        spans.append((rng.choice("xy"), a, min(255, a + rng.choice([0, 1, 3, 10, 60, 200])), f"s{i:03d}"))
    points = [(f, p) for f in "xyz" for p in range(0, 256)]
    got = {(r.f, r.p): r.uid for r in keyed.innermost(
        spark.createDataFrame(points, "f string, p int"), spark.createDataFrame(spans, "f string, a int, b int, uid string"), ["f"], "p", "a", "b", ["uid"]).collect()}
    for f, p in points:
        hits = [(-a, b, u) for ff, a, b, u in spans if ff == f and a <= p <= b]
        assert got[f, p] == (min(hits)[2] if hits else None)


def test_percentiles(spark):
    rng = random.Random(4)
    values = [("hot", 5.0)] * 200 + [("hot", float(rng.randrange(20))) for _ in range(101)] + [("one", 3.0)]
    df = spark.createDataFrame(values, "k string, v double")
    fractions = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.k, r.fraction): r.v for r in ME.percentiles(df, ["k"], "v", fractions).collect()}
    for k in ("hot", "one"):
        ordered = sorted(v for kk, v in values if kk == k)
        for f in fractions:
            assert got[k, f] == ordered[max(0, min(len(ordered) - 1, round(f * len(ordered) + 0.5) - 1))]


def test_collapse_chains(spark):
    rng = random.Random(6)
    for size, names in ((40, "abcdef"), (200, "abcdefghijklmnop"), (12, "ab")):
        moves = [(i, rng.choice(names), rng.choice(names)) for i in range(size)]
        at = {}
        for _, old, new in moves:
            at[new] = at.pop(old, old)
        want = {(o, n) for n, o in at.items() if o != n}
        rows = [("r", *m) for m in moves] + [("other", i, "a", "z") for i in range(1)]
        df = spark.createDataFrame(rows, "repo_id string, seq bigint, old_path string, new_path string")
        assert {tuple(r) for r in M.collapse_chains(df).collect()} == {("r", *w) for w in want} | {("other", "a", "z")}


def test_undetected_moves(spark):
    rng = random.Random(7)
    before = {f"o{i:02d}": {f"id{rng.randrange(25)}" for _ in range(rng.choice([1, 1, 2, 3]))} for i in range(30)}
    after = {f"n{i:02d}": {f"id{rng.randrange(25)}" for _ in range(rng.choice([1, 1, 2]))} for i in range(30)}
    before.update({f"p{i:02d}": {"copy"} for i in range(12)})
    after.update({f"q{i:02d}": {"copy"} for i in range(9)})
    want, used = set(), set()
    for o in sorted(before):
        for n in sorted(after):
            if n not in used and before[o] & after[n]:
                used.add(n)
                want.add((o, n))
                break
    flat = lambda d: spark.createDataFrame([(p, i) for p, ids in d.items() for i in ids], "rel_path string, identity string")
    assert {tuple(r) for r in M.undetected_moves(flat(before), flat(after)).collect()} == want


def test_impact_limits_and_cycles(spark):
    links = [(f"f{i + 1}", f"f{i}") for i in range(6)] + [("ping", "pong"), ("pong", "ping")] + [(f"c{i:02d}", "hub") for i in range(12)]
    names = sorted({n for e in links for n in e})
    symbols = spark.createDataFrame([(n, n, "m.py", i) for i, n in enumerate(names)], "uid string, qualified_name string, rel_path string, start_line int")
    edges = spark.createDataFrame([(s, t, "CALLS") for s, t in links], "src string, tgt string, kind string")
    asked = spark.createDataFrame([("chain", "f0"), ("loop", "ping"), ("many", "hub")], "question_id string, uid string")
    rows = G.impact(asked, symbols, edges, limit=10).collect()
    chain = {r.uid: r for r in rows if r.question_id == "chain"}
    assert sorted(chain) == ["f1", "f2", "f3", "f4"] and chain["f3"].path == ["f3", "f2", "f1", "f0"] and not chain["f1"].truncated
    assert [r.uid for r in rows if r.question_id == "loop"] == ["pong"]
    many = [r for r in rows if r.question_id == "many"]
    assert len(many) == 10 and all(r.truncated for r in many)


def test_small_tenant_keeps_its_rows(spark):
    import math
    def vec(angle):
        return [math.cos(angle), math.sin(angle)] + [0.0] * 6
    rows = [(f"big{i:03d}", "big", vec(0.15 * i / 300)) for i in range(300)] + [(f"s{i}", "small", vec(0.5 + i / 10)) for i in range(8)]
    vectors = spark.createDataFrame(rows, "uid string, tenant string, vector array<double>")
    asked = spark.createDataFrame([("q", "small", vec(0.0))], "question_id string, tenant string, vector array<double>")
    got = [r.uid for r in RT.nearest(vectors, asked, 5).orderBy("rank").collect()]
    assert got == ["s0", "s1", "s2", "s3", "s4"]


def tokens(text):
    import math
    import re
    lex = re.compile(r'"{3}(?:.|\n)*?"{3}' + r"|'{3}(?:.|\n)*?'{3}" + r'|"(?:\\.|[^"\\])*"' + r"|'(?:\\.|[^'\\])*'|#[^\n]*|[A-Za-z_]\w*|\d+\.?\d*|\s+|.", re.A)
    return sum(1 + m.count("\n") if m.isspace() else math.ceil(len(m) / 4) for m in lex.findall(text))


def parts_of(body, header, cap):
    whole = f"{header}\n{body}"
    lines = body.split("\n")
    indents = [len(l) - len(l.lstrip()) for l in lines[1:] if l.strip()]
    if tokens(whole) <= cap or not indents:
        return [whole]
    head, out, cur = tokens(header) + 1, [], []
    running = head
    for i, line in enumerate(lines):
        cost = tokens(line) + 1
        start = i > 0 and line.strip() and len(line) - len(line.lstrip()) == min(indents)
        if running + cost > cap and cur and start:
            out.append(cur)
            cur, running = [line], head + cost
        else:
            cur.append(line)
            running += cost
    return [f"{header}\n" + "\n".join(c) for c in [*out, cur]]


def test_token_count_and_overflow(spark):
    rng = random.Random(8)
    bodies = ["", "x", 'def f():\n    return "a\\"b"  # note', "'''doc\n\nmore''' 'x' 12.5 über"]
    for _ in range(12):
        bodies.append("def f(a):\n" + "\n".join("    " * rng.choice([1, 1, 2]) + "value = call(other_name, 12)" if rng.random() > .1 else "" for _ in range(rng.randrange(1, 40))))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    rows = {r.i: r for r in df.select("i", X.token_count(F.col("b")).alias("n"), packing.overflow_parts(F.col("b"), F.lit("# h :: f"), 60).alias("p"),
                                      packing.truncated(F.lit("# h"), F.col("b"), F.lit("python"), 60).alias("t")).collect()}
    for i, body in enumerate(bodies):
        assert rows[i].n == tokens(body)
        assert rows[i].p == parts_of(body, "# h :: f", 60)
        assert "lines shown⟩" in rows[i].t
        if tokens(body) > 60 and body.count("\n") > 12:
            assert tokens(rows[i].t) <= 60


def test_elision(spark):
    py = "class A:\n    def one(self):\n        x = 1\n        return x\n\n    def two(self): return 2\n"
    deco = "@wrap\n    def outer(self):\n        def inner():\n            a = 1\n            return a\n        return inner"
    ts = "function outer() {\n  const go = () => {\n    a();\n    b();\n  };\n  if (x) {\n    c();\n    d();\n  }\n}"
    rows = spark.createDataFrame([(0, py, "python"), (1, deco, "python"), (2, ts, "typescript"), (3, "no code (", "python")], "i int, s string, l string")
    got = {r.i: r.e for r in rows.select("i", packing.elide("s", "l").alias("e")).collect()}
    assert "# ⟨2 lines elided⟩" in got[0] and "return 2" in got[0] and "x = 1" not in got[0]
    assert "# ⟨2 lines elided⟩" in got[1] and "return inner" in got[1] and got[1].startswith("@wrap\n    def outer")
    assert "{ /* ⟨2 lines elided⟩ */ }" in got[2] and "c();" in got[2] and "a();" not in got[2]
    assert got[3] == "no code ("


def test_quiet_periods(spark):
    rng = random.Random(9)
    rows, t = [], 0
    for i in range(200):
        t += rng.choice([1, 2, 5, 40])
        rows.append((rng.choice("ab"), t, i))
    df = spark.createDataFrame(rows, "k string, s bigint, i int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: int(r.flush_start.timestamp()) for r in S.quiet_periods(df, ["k"], "ts", 10, bucket=lambda c: F.floor(F.unix_timestamp(c) / 30)).collect()}
    for k in "ab":
        start = last = None
        for kk, s, i in rows:
            if kk == k:
                if last is None or s - last > 10:
                    start = s
                last = s
                assert got[i] == start


def test_vlq(spark):
    cases = {"A": [0], "C": [1], "D": [-1], "gB": [16], "AAgBC": [0, 0, 16, 1]}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, v array<bigint>")
    for r in rows.select("s", "v", V.vlq_decode(F.col("s")).alias("d"), V.vlq_encode(F.col("v")).alias("e")).collect():
        assert r.d == r.v and r.e == r.s


def test_vlq_of_long_numbers(spark):
    def written(v):
        n, out = abs(v) * 2 + (v < 0), ""
        while True:
            n, d = n >> 5, n & 31
            out += C.VLQ_ALPHABET[d + 32 * (n > 0)]
            if not n:
                return out

    cases = [[2 ** 40, -(2 ** 40) - 1, 7], [2 ** 54 + 1, -(2 ** 60)], [], [0, -1, 31, 32, -512, 1023]]
    rows = spark.createDataFrame([("".join(map(written, v)), v) for v in cases], "s string, v array<bigint>")
    for r in rows.select("s", "v", V.vlq_decode(F.col("s")).alias("d"), V.vlq_encode(F.col("v")).alias("e")).collect():
        assert r.d == r.v and r.e == r.s
    odd = spark.createDataFrame([("Cg",), ("C=D",), (None,)], "s string").select(V.vlq_decode(F.col("s")).alias("d"))
    assert [r.d for r in odd.collect()] == [[1], [1, -15, -1], None]


def test_plans_prune_and_push_down(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "CALLS", "x"), ("c", "b", "IMPORTS", "x")], "src string, tgt string, kind string, origin_path string")
    edges.write.partitionBy("kind").parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    symbols = spark.createDataFrame([(u, u, "m", 1) for u in "abc"], "uid string, qualified_name string, rel_path string, start_line int")
    asked = spark.createDataFrame([("q", "b")], "question_id string, uid string")
    related = G.traverse(asked, symbols, e, "usages")
    assert {r.uid for r in related.collect()} == {"a", "c"}
    plan = G.traverse(asked, symbols, e, "definition")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "origin_path" not in plan and "CartesianProduct" not in plan


def test_related_symbols_are_walked_to_once(spark):
    edges = spark.createDataFrame([(s, t, k) for s, t, k in (
        ("a", "b", "CALLS"), ("c", "b", "IMPORTS"), ("c", "b", "CALLS"), ("b", "b", "CALLS"), ("d", "b", "CALLS"), ("a", "d", "CALLS"))], "src string, tgt string, kind string")
    symbols = spark.createDataFrame([(u, u, "m", k) for k, u in enumerate("abcd")], "uid string, qualified_name string, rel_path string, start_line int")
    asked = spark.createDataFrame([("q", "b"), ("q", "d"), ("r", "b"), (None, "d")], "question_id string, uid string")
    related = G.traverse(asked, symbols, edges, "usages")
    assert sorted(tuple(r) for r in related.filter("question_id is not null").select("question_id", "uid", "rel", "via").collect()) == [
        ("q", "a", "CALLS", ""), ("q", "c", "CALLS", ""), ("q", "c", "IMPORTS", ""), ("r", "a", "CALLS", ""), ("r", "c", "CALLS", ""),
        ("r", "c", "IMPORTS", ""), ("r", "d", "CALLS", "")]
    assert [r["uid"] for r in related.filter("question_id is null").collect()] == ["a"]
    out = G.shown(related.filter("question_id is not null"), symbols, 2)
    assert sorted((r["question_id"], r["uid"], r["position"], r["related_total"]) for r in out.collect()) == [
        ("q", "a", 1, 2), ("q", "c", 2, 2), ("r", "a", 1, 3), ("r", "c", 2, 3)]
    assert "src#" not in out._jdf.queryExecution().executedPlan().toString()


def test_open_bursts_keep_their_first_events(spark):
    from symtrail.streaming.bursts import open_bursts

    rows = [("a", 1, "2024-01-01 10:00:00"), ("a", 2, "2024-01-01 10:50:00"), ("a", 3, "2024-01-01 08:00:00"), ("b", 4, "2024-01-01 09:00:00")]
    events = spark.createDataFrame(rows, "user_id string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    # At 11:10 the event of 10:00 alone would be closed; its burst is open because of the later event.
    got = open_bursts(events, "user_id", "ts", "1 hour", "1 minute", F.lit("2024-01-01 11:10:00").cast("timestamp")).collect()
    assert [(r.user_id, r.flush_start.hour, r.flush_start.minute, r.writes, r.last_event) for r in got] == [("a", 10, 0, 2, 2)]


def test_questions_in_blocks_meet_vectors_in_tiles(spark):
    rng = random.Random(2)
    rows = [(k, f"t{k % 3 if k % 7 else 0}", [rng.gauss(0, 1) for _ in range(6)]) for k in range(300)] + [(900, "t0", None), (901, "t1", [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "uid long, tenant string, vector array<double>")
    asked = spark.createDataFrame([(f"q{k}", f"t{k % 4}", [rng.gauss(0, 1) for _ in range(6)]) for k in range(60)] + [("none", "t0", None)], "question_id string, tenant string, vector array<double>")
    key = lambda df: sorted((r.question_id, r.rank, r.uid, r.score) for r in df.collect())
    whole = key(RT.nearest(vectors, asked, 7))
    assert key(RT.nearest(vectors, asked, 7, block=5, tile=20)) == whole
    assert len(whole) == 45 * 7 and {q for q, *_ in whole} == {f"q{k}" for k in range(60) if k % 4 < 3}


def test_a_hub_is_cut_before_questions_meet_it(spark):
    """Many questions on one hub with more callers than are shown, and one question that has seen some of them."""
    symbols = [(f"s{k:03d}", f"n{k}", f"p{k % 7}.py", k) for k in range(400)]
    edges = [(f"s{k:03d}", "s000", "CALLS") for k in range(1, 300)] + [("s000", "s399", "CALLS"), ("s001", "s399", "CALLS"), ("s005", "s398", "CALLS"), ("s000", "s398", "CALLS"), ("s300", "s001", "CALLS")]
    sym = spark.createDataFrame(symbols, "uid string, qualified_name string, rel_path string, start_line int")
    edge = spark.createDataFrame(edges, "src string, tgt string, kind string")
    starts = {"a": ["s000"], "b": ["s399"], "c": ["s398", "s399"], "d": ["s000", "s001"]}
    ents = spark.createDataFrame([(q, u) for q, us in starts.items() for u in us], "question_id string, uid string")
    place = {u: (p, n, u) for u, _, p, n in symbols}
    got = {}
    for r in G.impact(ents, sym, edge, limit=20).collect():
        got.setdefault(r.question_id, []).append((r.position, r.uid, r.level, r.truncated))
    for q, us in starts.items():
        seen, frontier, out, cut = set(us), set(us), [], False
        for level in range(1, 5):
            new = sorted({s for s, t, _ in edges if t in frontier} - seen, key=place.get)
            for u in new[:20 - len(out)]:
                out.append((len(out) + 1, u, level))
            cut = len(seen) - len(us) + len(new) > 20
            seen |= set(new)
            frontier = set(new)
            if cut or not new:
                break
        assert sorted(got[q]) == [(*o, cut) for o in out]


def test_a_walk_stores_names_once(spark):
    """Many questions on one hub with long names: what the walk writes follows its numbers, not names and paths."""
    from pathlib import Path

    from symtrail.session import shared_dir
    rng = random.Random(4)
    name = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1500)) + str(k)
    sym = spark.createDataFrame([(f"s{k:03d}", name(k), "p.py", k) for k in range(41)], "uid string, qualified_name string, rel_path string, start_line int")
    edge = spark.createDataFrame([(f"s{k:03d}", "s000", "CALLS") for k in range(1, 41)], "src string, tgt string, kind string")
    ents = spark.range(300).select(F.col("id").cast("string").alias("question_id"), F.lit("s000").alias("uid"))
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    out = G.impact(ents, sym, edge)
    assert out.count() == 300 * 40 and out.filter("size(path) <> 2 or length(path[1]) < 1500").count() == 0
    assert size() - before < 2_000_000


def test_parsed_files_are_never_gathered_by_the_driver(spark, tmp_path):
    """Sizes guessed from a narrow scan say that two parses fit a broadcast; they must meet by shuffles all the same."""
    rows = [("r", f"m{k}.py", seq, f"u{k}.{seq}", "function", 0, 0, f"f{seq}") for k in range(5) for seq in range(2 + k)]
    cols = "repo_id string, rel_path string, seq int, uid string, kind string, arity int, ordinal int, name string"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    new = old.withColumn("rel_path", F.concat(F.lit("to/"), "rel_path")).withColumn("uid", F.concat(F.lit("n"), "uid"))
    short = new.filter("not (rel_path = 'to/m4.py' and seq = 5)")
    moves = old.select("repo_id", F.col("rel_path").alias("old_path"), F.concat(F.lit("to/"), "rel_path").alias("new_path")).distinct()
    out = M.remaps(moves, old, short)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(u, "n" + u, p, "to/" + p) for _, p, _, u, *_ in rows if p != "m4.py"}
    assert {(r.old_uid, r.new_uid, r.old_path, r.new_path) for r in out.collect()} == want


def test_copies_inside_a_wider_group_are_paired_at_once(spark, monkeypatch):
    """Equal texts in one group of equal lengths, on both sides and in any order: no round per pair."""
    rng = random.Random(9)
    side = lambda p: {f"{p}{k:02d}": {"length", f"text{rng.randrange(6)}"} for k in range(25)} | {f"{p}x{k}": {"lone"} for k in range(3)}
    before, after = side("o"), side("n")
    want, used = set(), set()
    for o in sorted(before):
        for n in sorted(after):
            if n not in used and before[o] & after[n]:
                used.add(n)
                want.add((o, n))
                break
    calls = []
    monkeypatch.setattr(M, "cut", lambda df, f=M.cut: calls.append(1) or f(df))
    flat = lambda d: spark.createDataFrame([(p, i) for p, ids in d.items() for i in ids], "rel_path string, identity string")
    assert {tuple(r) for r in M.undetected_moves(flat(before), flat(after)).collect()} == want
    assert len(calls) < 10


def test_lookup_without_hot_keys_shuffles_each_side_once(spark, capsys):
    left = spark.range(400).select((F.col("id") % 40).cast("int").alias("k"), F.col("id").alias("i"))
    right = spark.range(30).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    plain = sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    joined = keyed.lookup(left, right, ["k"], hot_rows=1_000)
    joined.explain()
    assert "_salt" not in capsys.readouterr().out
    assert sorted(map(tuple, joined.collect()), key=str) == plain
    # Keys of different integer types, some of them hot, and a left side that is written first.
    hot = left.unionByName(spark.range(300).select(F.lit(7).alias("k"), F.col("id").alias("i")))
    salted = keyed.lookup(hot, right, ["k"], hot_rows=100, settle=True)
    assert sorted(map(tuple, salted.select("k", "i", "v").collect()), key=str) == sorted(
        map(tuple, hot.join(right, "k", "left").select("k", "i", "v").collect()), key=str)


def test_relations_of_ambiguous_names_at_any_size(spark, monkeypatch, capsys):
    from symtrail.operators import grounding as GR
    symbols = spark.createDataFrame(
        [("r", "run", f"m{i}.run", f"u{i}", f"m{i}.py") for i in range(20)] + [("r", "log", "core.log", "L", "core.py")],
        "repo_id string, name string, qualified_name string, uid string, rel_path string")
    edges = spark.createDataFrame([(f"u{i}", "L", "CALLS") for i in range(0, 20, 2)] + [("u1", "u2", "IMPORTS")], "src string, tgt string, kind string")
    claims = spark.createDataFrame(
        [("r", "a", "run", "CALLS", "log"), ("r", "b", "m1.run", "CALLS", "log"), ("r", "c", "m2.run", "CALLS", "core.log"),
         ("r", "d", "run", "IMPORTS", "run"), ("r", "e", "ghost", "CALLS", "log"), ("r", "a", "run", "CALLS", "log")],
        "repo_id string, answer_id string, subject string, relation string, object string")
    columns = ["answer_id", "subject_found", "object_found", "edge_found", "contradicted"]
    want = [("a", True, True, True, False), ("a", True, True, True, False), ("b", True, True, False, True),
            ("c", True, True, True, False), ("d", True, True, True, False), ("e", False, True, False, False)]
    assert sorted(map(tuple, GR.verify_relations(claims, symbols, edges).select(*columns).collect())) == want
    monkeypatch.setattr(keyed, "small", lambda *a, **k: False)
    out = GR.verify_relations(claims, symbols, edges).select(*columns)
    assert sorted(map(tuple, out.collect())) == want
    out.explain()
    assert "_salt" not in capsys.readouterr().out


def test_bm25_shuffles_no_pair_of_question_and_document(spark, monkeypatch, capsys):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(300)], "uid long, search_text string")
    asked = spark.createDataFrame([(i, " ".join(rng.sample(words, 4))) for i in range(20)], "question_id long, query string")
    monkeypatch.setattr(RT, "POSTINGS_PER_TASK", 500)
    out = RT.bm25(docs, asked, k=7)
    out.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(question_id" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(question_id" in line and "uid" in line]
    counts = {r["uid"]: r["search_text"].split() for r in docs.collect()}
    sized = [len(w) for w in counts.values() if w]
    mean, n = sum(sized) / len(sized), len(sized)
    df = {w: sum(w in ws for ws in counts.values()) for w in words}
    weights = {(r["question_id"], r["term"]): r["weight"] for r in RT.query_terms(asked).collect()}
    got = {}
    for r in out.collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["uid"]))
    for question in range(20):
        score = {}
        for uid, ws in counts.items():
            for (q, t), weight in weights.items():
                if q == question and t in ws:
                    tf = ws.count(t)
                    score[uid] = score.get(uid, 0) + weight * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        want = sorted(score, key=lambda u: (-round(score[u], 9), u))[:7]
        assert [u for _, u in sorted(got[question])] == want
