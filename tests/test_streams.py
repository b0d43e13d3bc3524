"""Quiet periods and the stat-polling source."""

import os
import random

import pytest
from pyspark.sql import functions as F

from symtrail.sources import stats
from symtrail.streaming import indexing, quiet


def brute_flushes(events, gap):
    """{(key, first, slot): (writes, last)} of (key, at, slot, order) rows."""
    out = {}
    for key in {e[0] for e in events}:
        mine = sorted((at, order, slot) for k, at, slot, order in events if k == key)
        first = last = None
        for at, order, slot in mine:
            if last is None or at - last > gap:
                first = at
            last = at
            writes, _ = out.get((key, first, slot), (0, None))
            out[key, first, slot] = (writes + 1, order)
    return out


def random_events(seed, n=400, keys=3, span=3_000):
    rng = random.Random(seed)
    return [(rng.randrange(keys), rng.randrange(span), f"p{rng.randrange(4)}", k) for k in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_spans_do_not_depend_on_the_order_of_events(seed):
    events = [e for e in random_events(seed, 120) if e[0] == 0]
    spans = quiet.Spans([], 30)
    for _, at, slot, order in events:
        spans.add(at, slot, (at, order))
    got = {(0, s.start, slot): (writes, order[1]) for s in spans.spans for slot, (order, writes) in s.slots.items()}
    assert got == brute_flushes(events, 30)
    assert spans.ends == [s.end for s in spans.spans] == sorted(spans.ends)


def test_flushes_over_batches_with_late_events(spark, tmp_path):
    """Many small files, shuffled within what the watermark allows: the state's bursts grow at both ends and join."""
    events = [(k, at + 10_000, slot, order) for k, at, slot, order in random_events(7)]
    rng = random.Random(1)
    arriving = sorted(events, key=lambda e: e[1] + rng.uniform(0, 200))
    for k in range(0, len(arriving), 80):
        part = spark.createDataFrame(arriving[k:k + 80], "repo_id long, at long, slot string, seq long").withColumn("ts", F.timestamp_seconds("at")).coalesce(1)
        part.write.parquet(str(tmp_path / f"in/{k:04d}"))
        for name in os.listdir(tmp_path / f"in/{k:04d}"):
            os.utime(tmp_path / f"in/{k:04d}" / name, (k, k))
    rows = spark.readStream.schema("repo_id long, at long, slot string, seq long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = quiet.run_once(spark, rows, str(tmp_path / "run"), ["repo_id"], F.col("slot"), "ts", "seq", 30, "5 minutes").collect()
    got = {(r["repo_id"], int(r["flush_start"].timestamp()), r["slot"]): (r["writes"], r["seq"]) for r in found}
    assert len(found) == len(got) and got == brute_flushes(events, 30)


class Recorder:
    """Stands for an engine: what each write was given."""

    def __init__(self, spark):
        self.spark, self.writes = spark, []

    def write(self, batch, deleted=None, moves=None, tree=None):
        gone = sorted((r.repo_id, r.rel_path) for r in deleted.collect())
        moved = sorted((r.repo_id, r.old_path, r.new_path) for r in moves.collect()) if moves is not None else []
        self.writes.append((sorted((r.repo_id, r.rel_path, bytes(r.content)) for r in batch.collect()), gone, moved))


def test_a_repository_is_written_when_it_is_quiet(spark, tmp_path):
    at = "2024-01-01 00:00:%02d"
    saves = [("a", "x.py", b"1", at % 0, 1, None), ("a", "x.py", b"2", at % 1, 2, None), ("a", "y.py", b"3", at % 2, 3, None), ("a", "gone.py", None, at % 2, 4, None),
             ("a", "new.py", None, at % 3, 5, "old.py"), ("b", "z.py", b"4", at % 3, 6, None), ("b", "z.py", b"5", at % 30, 7, None)]
    df = spark.createDataFrame(saves, "repo_id string, rel_path string, content binary, ts string, seq long, old_path string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    engine = Recorder(spark)
    source = spark.readStream.schema(indexing.SAVES).parquet(str(tmp_path / "in"))
    run = indexing.start_quiet(engine, source, str(tmp_path / "run"), 2.0, late="0 seconds", interval=None)
    run.awaitTermination()
    # The watermark stands at second 30: what was saved then is armed still.
    assert engine.writes == [([("a", "x.py", b"2"), ("a", "y.py", b"3"), ("b", "z.py", b"4")], [("a", "gone.py")], [("a", "old.py", "new.py")])]
    run.settle()
    assert engine.writes[1:] == [([("b", "z.py", b"5")], [], [])]


def test_quiet_by_time_of_arrival(spark, tmp_path):
    engine, folder = Recorder(spark), tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(indexing.SAVES).parquet(str(folder))
    run = indexing.start_quiet(engine, source, str(tmp_path / "run"), 1.0, interval="200 milliseconds")
    try:
        df = spark.createDataFrame([("a", "x.py", bytearray(b"1"), 1, None)], "repo_id string, rel_path string, content binary, seq long, old_path string")
        df.withColumn("ts", F.current_timestamp()).select("repo_id", "rel_path", "content", "ts", "seq", "old_path").coalesce(1).write.mode("append").parquet(str(folder))
        for _ in range(120):
            if engine.writes or run.flushes.exception():
                break
            run.flushes.awaitTermination(1)
    finally:
        run.stop()
    assert engine.writes == [([("a", "x.py", b"1")], [], [])]


# -- polling ---------------------------------------------------------------------------------------------

def put(root, path, text, at):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_text(text)
    os.utime(full, ns=(at, at))


def test_stat_tree_and_snapshots(tmp_path):
    root, at = tmp_path / "tree", 10 ** 18
    for path in ("a.py", "pkg/b.py", "pkg/deep/c.ts", "pkg/notes.txt", "node_modules/d.py", ".git/e.py"):
        put(root, path, "x", at)
    (root / "link").symlink_to(root / "pkg", target_is_directory=True)
    tree = stats.stat_tree(str(root))
    assert tree == {"": {"a.py": (at, 1)}, "pkg": {"pkg/b.py": (at, 1), "pkg/deep/c.ts": (at, 1)}}
    shots = stats.Snapshots(str(tmp_path / "shots"))
    assert shots.add(tree) == 0 and shots.add(tree) == 0 and shots.add(tree, always=True) == 1
    put(root, "pkg/b.py", "yy", at)
    assert shots.add(stats.stat_tree(str(root))) == 2
    old, new = shots.index(1), shots.index(2)
    assert old[""] == new[""] and old["pkg"] != new["pkg"]         # an unchanged folder keeps its file
    shots.forget(2)
    assert shots.numbers() == [2] and shots.stats(new["pkg"])["pkg/b.py"] == (at, 2)
    assert not os.path.exists(tmp_path / "shots" / old["pkg"]) and shots.stats(None) == {}
    assert stats.stat_tree(str(tmp_path / "nowhere")) == {}


def test_changes_arrive_once_and_priming_tells_nothing(spark, tmp_path):
    root, at = tmp_path / "tree", 10 ** 18
    for path in ("a.py", "pkg/b.py", "pkg/c.py", "other/d.py"):
        put(root, path, "x", at)
    told = []

    def look():
        stream = stats.changes(spark, str(root), "r", str(tmp_path / "shots"))
        keep = lambda batch, _id: told.extend((r.rel_path, r.change, r.content and bytes(r.content)) for r in batch.collect())
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        out = sorted(told)
        told.clear()
        return out

    assert look() == []
    put(root, "a.py", "x", at + 1)
    put(root, "pkg/b.py", "longer", at)
    put(root, "pkg/new/e.py", "new", at)
    os.remove(root / "pkg/c.py")
    os.remove(root / "other/d.py")
    assert look() == [("a.py", "saved", b"x"), ("other/d.py", "removed", None), ("pkg/b.py", "saved", b"longer"), ("pkg/c.py", "removed", None), ("pkg/new/e.py", "saved", b"new")]
    assert look() == []


def test_watch_leaves_touched_files_alone(spark, tmp_path):
    root, at = tmp_path / "tree", 10 ** 18
    put(root, "a.py", "same", at)
    put(root, "b.py", "old", at)
    engine = Recorder(spark)
    held = spark.createDataFrame([("r", "a.py", __import__("hashlib").sha256(b"same").hexdigest())], "repo_id string, rel_path string, content_hash string")
    engine.store = type("Store", (), {"read": lambda self: type("G", (), {"files": held})()})()

    def look():
        stream = stats.changes(spark, str(root), "r", str(tmp_path / "shots"))
        indexing.watch(engine, stream, str(tmp_path / "cp"), interval=None).awaitTermination()

    look()
    put(root, "a.py", "same", at + 5)
    look()
    assert engine.writes == []
    put(root, "b.py", "new!", at)
    os.remove(root / "a.py")
    look()
    assert engine.writes == [([("r", "b.py", b"new!")], [("r", "a.py")], [])]


def test_a_key_of_many_bursts_touches_its_state_once():
    """A batch reads and writes a key's state and timer as often for 200 bursts as for one."""
    from types import SimpleNamespace

    class Value:
        def __init__(self):
            self.value, self.calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.update(None)

    state, timers = Value(), []
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.append, deleteTimer=timers.remove)
    one = quiet.QuietPeriods(["k"], 30_000_000, False)
    one.init(handle)
    clock = lambda ms: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0, getCurrentWatermarkInMs=lambda: ms)
    rows = [{"at": k * 100_000_000, "slot": f"p{k % 3}", "ord": k} for k in range(200)]
    assert list(one.handleInputRows((1,), iter(rows), clock(0))) == []
    assert state.calls == 2 and timers == [30_001]
    info = lambda: SimpleNamespace(getExpiryTimeInMs=lambda due=timers.pop(): due)
    told = list(one.handleExpiredTimer((1,), clock(10_000_000), info()))
    assert [(r.start, r.slot, r.writes, r.ord) for r in told] == [(k * 100_000_000, f"p{k % 3}", 1, k) for k in range(100)]
    assert state.calls == 4 and timers == [100 * 100_000 + 30_001]
    told = list(one.handleExpiredTimer((1,), clock(10**12), info()))
    assert [r.ord for r in told] == list(range(100, 200)) and state.value is None and timers == []
