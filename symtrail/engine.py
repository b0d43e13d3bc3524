"""The facade: keep a code graph current, and answer batches of questions from it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from symtrail import constants as K, schema as SC
from symtrail.functions import questions as Q
from symtrail.operators import (chunking, embedding, entities as E, frames as FR, graph as G, grounding as GR, maintenance as M,
                                packing, resolve as R, retries as RY, retrieval as RT)
from symtrail.operators.maintenance import Graph
from symtrail.counters import Counters
from symtrail.session import cut
from symtrail.sources import parse
from symtrail.sources.meta import Meta
from symtrail.sources.snapshots import Snapshots, conform


@dataclass
class Report:
    """What one write did; every field is a DataFrame or a number."""

    epoch: int
    outcomes: DataFrame | None = None
    relink: DataFrame | None = None
    changes: DataFrame | None = None
    counters: dict = field(default_factory=dict)


class CodeGraph:
    """One store of graph snapshots, written by one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, provider=None):
        self.spark = spark
        self.store = Snapshots(spark, f"{root.rstrip('/')}/graph")
        self.cache_path = f"{root.rstrip('/')}/embedding_cache"
        self.meta = Meta(spark, f"{root.rstrip('/')}/meta")
        self.provider = provider or embedding.DisabledProvider()

    # -- writing -----------------------------------------------------------------------------------

    def next_epoch(self) -> int:
        """Greater than every epoch before it, and the wall clock while the clock is right."""
        return max(time.time_ns(), self.store.current() + 1)

    def cache(self) -> DataFrame:
        fs, path = self.store._fs(self.cache_path)
        if not fs.exists(path):
            return SC.empty(self.spark, SC.EMBEDDING_CACHE)
        return self.spark.read.schema(SC.EMBEDDING_CACHE).parquet(self.cache_path)

    def _symbols(self, facts: DataFrame, stored: DataFrame, epoch: int, counters: Counters, rewrite: bool) -> DataFrame:
        """Parsed symbols with chunks, hashes and (cached or fresh) vectors."""
        rows = cut(chunking.with_chunks(parse.symbols(facts)).withColumn("epoch", F.lit(epoch).cast("bigint")))
        return self._embedded(rows, stored, counters, rewrite)

    def _embedded(self, rows: DataFrame, stored: DataFrame | None, counters: Counters, rewrite: bool) -> DataFrame:
        """Rows with vectors.  Unless the whole repository is embedded (`rewrite`), one that another model
        embedded gets none: a few vectors of a second model would be compared as if they belonged."""
        mine = rows
        if not rewrite:
            gate = embedding.vector_gate(rows, self.meta.read(), self.provider)
            fits = gate.filter(F.col("recorded").isNull() | (F.col("recorded") == self.provider.name)).select("repo_id")
            mine = rows.join(fits, "repo_id", "left_semi")
        vectors, fresh = embedding.embed_symbols(mine, self.cache(), self.provider, stored, counters)
        vectors, fresh = cut(vectors), cut(fresh)
        if not fresh.isEmpty():
            fresh.write.mode("append").partitionBy("model").parquet(self.cache_path)
        return rows.join(vectors.withColumnRenamed("vector", "code_vec"), "uid", "left")

    def write(self, batch: DataFrame, deleted: DataFrame | None = None, moves: DataFrame | None = None,
              epoch: int | None = None, tree: DataFrame | None = None, stop_after: str | None = None, rewrite: bool = False) -> Report:
        """Apply one batch of files under one epoch: upsert, resolve, drop what is stale, then link
        again the files of `tree` whose edges pointed at replaced symbols or waited for new names.

        Names resolve inside a repository, so only the repositories of the batch are read and written."""
        epoch = epoch or self.next_epoch()
        paths = batch.select("repo_id", "rel_path")
        if deleted is not None:
            paths = paths.unionByName(deleted.select("repo_id", "rel_path"))
        if moves is not None:
            batch, moves = self._arriving(batch, cut(moves), tree)
            paths = paths.unionByName(batch.select("repo_id", "rel_path"))
            paths = paths.unionByName(moves.select("repo_id", F.col("old_path").alias("rel_path")))
        paths = cut(paths.distinct())
        repos = cut(paths.select("repo_id").distinct())
        graph = self.store.read(repos=repos)
        counters = Counters()
        if moves is not None:
            counters.add("move.total", moves.count())
            graph = self._move(graph, moves, batch, epoch)
        graph, report = self._apply(graph, batch, paths, epoch, counters, rewrite)
        if tree is not None and not report.relink.isEmpty():
            again = tree.select(*batch.columns).join(report.relink, ["repo_id", "rel_path"], "left_semi").join(paths, ["repo_id", "rel_path"], "left_anti")
            again = cut(again)
            if not again.isEmpty():
                epoch += 1
                graph, _ = self._apply(graph, again, cut(again.select("repo_id", "rel_path")), epoch, counters, rewrite)
        self.store.commit(graph, epoch, repos, stop_after)
        report.epoch, report.counters = epoch, counters.values()
        return report

    def _arriving(self, batch: DataFrame, moves: DataFrame, tree: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The batch with the content of moved files, from the batch itself or `tree`, and the moves whose
        content is known.  Others are left alone: their rows stay at the old path."""
        key = ["repo_id", "rel_path"]
        if tree is not None:
            wanted = moves.select("repo_id", F.col("new_path").alias("rel_path"))
            rest = tree.join(wanted, key, "left_semi").join(batch.select(*key), key, "left_anti")
            batch = cut(batch.unionByName(rest.select(*batch.columns)))
        known = batch.select("repo_id", F.col("rel_path").alias("new_path")).distinct()
        return batch, cut(moves.join(known, ["repo_id", "new_path"], "left_semi"))

    def _move(self, graph: Graph, moves: DataFrame, batch: DataFrame, epoch: int) -> Graph:
        new = batch.join(moves.select("repo_id", F.col("new_path").alias("rel_path"), "old_path"), ["repo_id", "rel_path"])
        cols = ["repo_id", "rel_path", "seq", "uid", "kind", "arity", "ordinal", "name"]
        as_new = parse.symbols(parse.facts(new)).select(*cols)
        as_old = parse.symbols(parse.facts(new.withColumn("rel_path", F.col("old_path")))).select(*cols)
        mapping = cut(M.remaps(moves.select("repo_id", "old_path", "new_path"), as_old, as_new))
        return M.apply_remaps(graph, mapping, epoch)

    def _apply(self, graph: Graph, batch: DataFrame, paths: DataFrame, epoch: int, counters: Counters, rewrite: bool = False) -> tuple[Graph, Report]:
        facts = cut(counters.watch(parse.facts(batch), {"index.files": F.count(F.lit(1))}))
        fresh = cut(conform(self._symbols(facts, graph.symbols, epoch, counters, rewrite).withColumn("created_epoch", F.lit(epoch)), SC.SYMBOLS))
        files = conform(parse.file_rows(batch).withColumn("epoch", F.lit(epoch)), SC.FILES)
        symbols = cut(M.upsert(conform(graph.symbols, SC.SYMBOLS), fresh.drop("created_epoch", "degree"), ["uid"], True, epoch))
        found = R.resolve(cut(parse.raw_edges(facts)), cut(R.visible(symbols, paths, epoch)), fresh)
        became = lambda *names: F.count_if(F.col("outcome").isin(*names))
        outcomes = cut(counters.watch(found.outcomes, {
            "edge.resolved": became("given", "resolved"), "edge.ambiguous": became("ambiguous"),
            "edge.unresolved": F.count_if(~F.col("outcome").isin("given", "resolved", "ambiguous", "not_a_class"))}))
        edges = M.upsert_edges(graph.edges, cut(found.edges), symbols, epoch)
        edges = cut(M.without_stale_edges(edges, symbols, paths, epoch))
        waiting = cut(R.waiting_hints(outcomes))
        listed = waiting.groupBy("repo_id", "rel_path").agg(F.sort_array(F.collect_set("target_hint")).alias("waiting"))
        files = files.drop("waiting").join(listed, ["repo_id", "rel_path"], "left").withColumn(
            "waiting", F.coalesce("waiting", F.array().cast("array<string>")))
        all_files = M.upsert(conform(graph.files, SC.FILES), conform(files, SC.FILES), ["repo_id", "rel_path"])
        merged = Graph(all_files, symbols, edges)
        relink = M.outside_callers(merged, paths, epoch)
        created = symbols.filter(F.col("created_epoch") == epoch).select("repo_id", "qualified_name", "kind")
        others = graph.files.join(paths, ["repo_id", "rel_path"], "left_anti").select(
            "repo_id", "rel_path", F.explode("waiting").alias("target_hint"))
        relink = cut(relink.unionByName(R.files_waiting_for(others, created)).distinct())
        kept = M.without_orphans(merged, paths, epoch)
        degrees = G.degrees(kept.symbols, kept.edges)
        kept = Graph(cut(kept.files), cut(kept.symbols.drop("degree").join(degrees, "uid")), cut(kept.edges))
        return kept, Report(epoch, outcomes, relink)

    def sync(self, tree: DataFrame, repos: DataFrame | None = None) -> Report:
        """Index everything: every file is parsed and every edge resolved again, and the model that embedded
        the repositories is recorded, unless it was not there."""
        report = self.reconcile(tree, reparse_all=True, repos=repos)
        if "index.embedding_unavailable" not in report.counters:
            self._record(tree.select("repo_id").distinct())
        return report

    def _record(self, repos: DataFrame) -> None:
        self.meta.put(repos.select(embedding.embedder_key(F.col("repo_id")).alias("key"), F.lit(self.provider.name).alias("value")))

    def reembed(self, repos: DataFrame) -> Report:
        """Vectors of the present model for all symbols of `repos` (repo_id), without parsing: those the cache
        has come from there, and repositories that the model embedded already are left alone."""
        gate = embedding.vector_gate(repos, self.meta.read(), self.provider)
        other = cut(gate.filter(~F.col("recorded").eqNullSafe(F.lit(self.provider.name))).select("repo_id"))
        if other.isEmpty():
            return Report(self.store.current())
        graph, counters = self.store.read(repos=other), Counters()
        rows = cut(chunking.with_keys(graph.symbols.drop("code_vec")))
        symbols = cut(conform(self._embedded(rows, None, counters, True), SC.SYMBOLS))
        epoch = self.next_epoch()
        self.store.commit(Graph(cut(graph.files), symbols, cut(graph.edges)), epoch, other)
        seen = counters.values()
        if "index.embedding_unavailable" not in seen:
            self._record(other)
        return Report(epoch, counters=seen)

    def bootstrap(self, tree: DataFrame) -> tuple[DataFrame, list[Report]]:
        """Bring all repositories of a tree level with it: (`embedding.bootstrap_decision`, what was written)."""
        plan = cut(embedding.bootstrap_decision(tree, self.store.read().files, self.meta.read(), self.provider))
        which = lambda *names: plan.filter(F.col("action").isin(*names)).select("repo_id")
        of = lambda repos: tree.join(repos, "repo_id", "left_semi")
        actions = {r["action"] for r in plan.select("action").distinct().collect()}
        reports = []
        if "index" in actions:
            reports.append(self.sync(of(which("index")), which("index")))
        if "reembed" in actions:
            reports.append(self.reembed(which("reembed")))
        if actions & {"reembed", "reconcile"}:
            rest = which("reembed", "reconcile")
            reports.append(self.reconcile(of(rest), repos=rest))
        return plan, reports

    def reconcile(self, tree: DataFrame, reparse_all: bool = False, repos: DataFrame | None = None) -> Report:
        """Bring the graph to a tree: only added, changed and deleted files are touched.

        The tree is that of all repositories, or of `repos` (repo_id): what it lacks of them is deleted."""
        known = self.store.read(repos=repos).files
        changes = cut(M.reconcile_diff(parse.file_rows(tree), known, reparse_all))
        if changes.isEmpty():
            return Report(self.store.current(), changes=changes)
        live = changes.filter("change <> 'deleted'").select("repo_id", "rel_path")
        report = self.write(tree.join(live, ["repo_id", "rel_path"], "left_semi"), changes.filter("change = 'deleted'"), rewrite=reparse_all)
        report.changes = changes
        return report

    def stats(self) -> DataFrame:
        g = self.store.read()
        return G.stats(g.files, g.symbols, g.edges)

    # -- asking --------------------------------------------------------------------------------------

    def ask(self, questions: DataFrame, root: str | None = None, query_vectors: DataFrame | None = None,
            available: int = K.AVAILABLE, maps: DataFrame | None = None) -> "Answered":
        """Route, retrieve and pack a batch `question_id, repo_id, query`."""
        graph = self.store.read()
        gate = cut(embedding.vector_gate(questions, self.meta.read(), self.provider)) if query_vectors is not None else None
        return ask(graph, questions, root, query_vectors, available, maps, gate)


    def retry(self, answered: "Answered", answers: DataFrame, retries: int = 0, available: int = K.AVAILABLE) -> "Retried":
        """Check `answers` (question_id, text) and pack again for those whose report is poor.

        One retry, never a loop: with `retries` made already, nothing is due."""
        graph = self.store.read()
        told = answers.select(F.col("question_id").alias("answer_id"), "text")
        classified = cut(GR.sentences(told))
        repos = answered.routed.select(F.col("question_id").alias("answer_id"), "repo_id")
        claims = GR.relation_claims(classified).join(repos, "answer_id")
        verdicts = cut(GR.verify_relations(claims, graph.symbols, graph.edges))
        report = cut(GR.report(classified, verdicts, retries))
        context = answered.packed.withColumnRenamed("question_id", "answer_id")
        due = report.filter("retry").select("answer_id")
        plan = cut(GR.retry_plan(classified, verdicts, context).join(due, "answer_id", "left_semi").withColumnRenamed("answer_id", "question_id"))
        columns = ["rel_path", "enclosing_signature", "signature", "docstring", "source_code", "used_imports"]
        whole = lambda blocks: blocks.join(graph.symbols.select("uid", *columns), "uid")
        first = whole(answered.blocks.join(plan.select("question_id").distinct(), "question_id", "left_semi"))
        seeds = plan.filter("action = 'expand'").select("question_id", "uid", F.lit(1.0).alias("score"))
        near = whole(G.expand(seeds, graph.symbols, graph.edges).select("question_id", "uid", F.lit("neighbor").alias("role"), "score"))
        ready = packing.rendered(first, packing.per_seed(available))
        again = RY.second_blocks(first, plan, near)
        packed = cut(RY.repack(ready, again, available))
        return Retried(report.withColumnRenamed("answer_id", "question_id"), plan, packed, RY.delta(answered.packed, packed))


@dataclass
class Retried:
    report: DataFrame       # question_id, claims, cited, ..., retry
    plan: DataFrame         # question_id, action (promote, expand), uid
    packed: DataFrame       # the second context of the questions in the plan
    delta: DataFrame        # its rows that the first context did not show


@dataclass
class Answered:
    routed: DataFrame       # question_id, repo_id, query_class, decided_by, rule, route_taken
    entities: DataFrame     # question_id, term, verdict, candidates
    related: DataFrame      # question_id, uid, via, path, position, related_total, truncated
    frames: DataFrame       # question_id, frame_no, ..., uid, tier, badge
    blocks: DataFrame       # question_id, uid, role, score
    packed: DataFrame
    notes: DataFrame        # question_id, note: what was not done, and why


def ask(graph: Graph, questions: DataFrame, root: str | None = None, query_vectors: DataFrame | None = None,
        available: int = K.AVAILABLE, maps: DataFrame | None = None, gate: DataFrame | None = None) -> Answered:
    """See `CodeGraph.ask`.  `maps` are source maps (`sources.tree.source_maps`) for compiled frames, `gate` is
    `embedding.vector_gate`: where vectors are not usable, search goes without them and a note says why."""
    symbols, edges = graph.symbols, graph.edges
    routed = cut(questions.select("question_id", "repo_id", "query", Q.route(F.col("query")).alias("r")).select(
        "question_id", "repo_id", "query", "r.*"))

    # Structural: entity, then one plan per rule that was asked.
    structural = routed.filter("query_class = 'STRUCTURAL'")
    resolved = cut(E.resolve(structural, symbols))
    entities = cut(E.entity_uids(resolved, symbols).join(structural.select("question_id", "rule"), "question_id"))
    parts = []
    for rule in [r["rule"] for r in structural.select("rule").distinct().collect()]:
        mine = entities.filter(F.col("rule") == rule).select("question_id", "uid")
        if rule == "impact":
            walk = G.impact(mine, symbols, edges)
            total = walk.groupBy("question_id").agg(F.count(F.lit(1)).alias("related_total"), F.max("truncated").alias("truncated"))
            parts.append(walk.drop("truncated").join(total, "question_id").select("question_id", "uid", F.lit("").alias("via"), "path",
                                                                                  F.col("position").cast("int").alias("position"), "related_total", "truncated"))
        else:
            parts.append(G.shown(G.traverse(mine, symbols, edges, rule), symbols).select(
                "question_id", "uid", "via", F.array().cast("array<string>").alias("path"), "position", "related_total",
                (F.col("related_total") > K.STRUCTURAL_RESULT_LIMIT).alias("truncated")))
    shape = "question_id string, uid string, via string, path array<string>, position int, related_total bigint, truncated boolean"
    related = SC.empty(questions.sparkSession, shape)
    for part in parts:
        related = related.unionByName(part)
    related = cut(related)
    sizes = entities.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_entities"))
    full = F.greatest(F.lit(0), F.lit(K.SEED_COUNT) - F.col("n_entities"))
    shown = related.join(sizes, "question_id").withColumn("shown", F.least("related_total", F.lit(K.STRUCTURAL_RESULT_LIMIT)))
    score = F.when(F.col("position") <= full, 2.0 - (F.col("position") - 1) / (F.col("shown") + 1)).otherwise(
        1.0 - (F.col("position") - 1 - full) / (F.col("shown") + 1))
    s_blocks = entities.select("question_id", "uid", F.lit("seed").alias("role"), F.lit(3.0).alias("score")).unionByName(
        shown.select("question_id", "uid", F.when(F.col("position") <= full, "seed").otherwise("neighbor").alias("role"), score.alias("score")))

    # Traces: frames through the tiers; what stays open is searched by message and names.
    traces = routed.filter("query_class = 'TRACE'")
    raw = FR.frames_of(traces).join(traces.select("question_id", "repo_id"), "question_id")
    positions = cut(FR.map_positions(FR.map_segments(maps))) if maps is not None else None
    frames = cut(FR.resolve(raw, symbols, graph.files.select("repo_id", "rel_path"), root, maps, positions))
    leads = cut(FR.trace_seeds(frames))
    fallback = FR.fallback_query(traces, frames).filter("query <> ''")

    # Search: explanatory questions, refused structural ones, and open traces.
    refused = resolved.filter("verdict <> 'resolved'").select("question_id")
    free = routed.filter("query_class = 'SEMANTIC'").unionByName(structural.join(refused, "question_id", "left_semi"))
    searches = cut(free.select("question_id", "repo_id", "query").unionByName(
        fallback.join(traces.select("question_id", "repo_id"), "question_id").select("question_id", "repo_id", "query")))
    arms = {"fulltext": RT.bm25(symbols, searches, tenant="repo_id")}
    if query_vectors is not None:
        vectors = symbols.filter("code_vec is not null").select("uid", F.col("repo_id").alias("tenant"), F.col("code_vec").alias("vector"))
        searched = searches if gate is None else searches.join(gate.filter("usable").select("repo_id"), "repo_id", "left_semi")
        arms["vector"] = RT.nearest(vectors, query_vectors.join(searched.select("question_id", F.col("repo_id").alias("tenant")), "question_id"))
    fused = cut(RT.fuse(arms))
    free_seeds = RT.semantic_seeds(fused.join(leads.select("question_id").distinct(), "question_id", "left_anti"))
    room = fused.join(leads.select("question_id", "uid"), ["question_id", "uid"], "left_anti")
    held = leads.groupBy("question_id").agg(F.count(F.lit(1)).alias("held"))
    fill = RT.ranked(room.join(held, "question_id").select("question_id", "uid", "score", "held"), K.SEED_COUNT).filter(
        F.col("rank") + F.col("held") <= K.SEED_COUNT)
    seeds = cut(free_seeds.select("question_id", "uid", "score").unionByName(leads.select("question_id", "uid", "score")).unionByName(
        fill.select("question_id", "uid", "score")))
    near = G.expand(seeds, symbols, edges).join(seeds.select("question_id", "uid"), ["question_id", "uid"], "left_anti")
    blocks = s_blocks.unionByName(seeds.select("question_id", "uid", F.lit("seed").alias("role"), "score")).unionByName(
        near.select("question_id", "uid", F.lit("neighbor").alias("role"), "score"))
    blocks = cut(blocks)
    columns = ["rel_path", "enclosing_signature", "signature", "docstring", "source_code", "used_imports"]
    packed = packing.pack(blocks.join(symbols.select("uid", *columns), "uid"), available)
    back = refused.withColumn("_back", F.lit(True))
    routes = routed.join(back, "question_id", "left").withColumn(
        "route_taken", F.when(F.col("_back"), "SEMANTIC").otherwise(F.col("query_class"))).drop("_back", "query")
    return Answered(routes, resolved, related, frames, blocks, packed, _notes(questions, searches, resolved, related, query_vectors, gate))


def _notes(questions: DataFrame, searches: DataFrame, resolved: DataFrame, related: DataFrame, query_vectors: DataFrame | None, gate: DataFrame | None) -> DataFrame:
    """What an answer's reader should know: an entity that was not found or is ambiguous, a list that was cut
    short, and a search that went without vectors."""
    unclear = resolved.filter("verdict <> 'resolved'").select("question_id", F.concat(F.lit("the name in question is "), "verdict", F.lit(": searched instead")).alias("note"))
    short = related.groupBy("question_id").agg(F.max("truncated").alias("t"), F.max("related_total").alias("n"), F.count(F.lit(1)).alias("shown")).filter("t").select(
        "question_id", F.format_string("%d of %d results are listed", "shown", "n").alias("note"))
    out = unclear.unionByName(short)
    if query_vectors is None:
        return out
    why = F.lit("") if gate is None else F.col("reason")
    off = (searches if gate is None else searches.join(gate.select("repo_id", "reason"), "repo_id")).filter(why != "")
    return out.unionByName(off.select("question_id", F.concat(F.lit("vector search is off: "), why).alias("note")))
