"""Evidence blocks into a token budget, and oversized bodies into parts.

The fold runs over at most a seed list and a neighbour list per question (both limits of retrieval),
and over costs only; texts are joined back afterwards.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from symtrail import constants as K
from symtrail.functions import text as X


# -- elision ---------------------------------------------------------------------------------------

def _elide_python(source: str) -> str:
    pad = ""
    if source.startswith("@") and "\n" in source:
        second = source.split("\n", 1)[1]
        pad = "if 1:\n" + " " * (len(second) - len(second.lstrip(" ")) or 1)
    text = pad + source
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return source
    defs = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    nested = []

    def visit(node, inside):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, defs) and inside:
                nested.append(child)
            else:
                visit(child, inside or isinstance(child, defs))

    visit(tree, False)
    starts = [0]
    data = text.encode()
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line.encode()) + 1)
    for node in sorted(nested, key=lambda n: -n.lineno):
        first = min([(node.body[0].lineno, node.body[0].col_offset),
                     *((d.lineno, d.col_offset - 1) for d in getattr(node.body[0], "decorator_list", []))])
        lo = starts[first[0] - 1] + first[1]
        hi = starts[node.end_lineno - 1] + node.end_col_offset
        lines = data[lo:hi].count(b"\n") + 1
        if lines > 1:
            data = data[:lo] + K.ELISION.format(n=lines).encode() + data[hi:]
    return data.decode(errors="replace")[len(pad):]


def _elide_script(source: str) -> str:
    import re

    from symtrail.sources.ts_facts import _brackets, _mask

    code = _mask(source)
    pairs, _ = _brackets(code)
    control = re.compile(r"\b(?:if|for|while|switch|catch|with)\s*\Z")
    bodies = []
    for left, right in sorted(pairs.items()):
        if code[left] != "{":
            continue
        before = code[:left].rstrip()
        called = re.search(r"\)\s*(?::[^(){};]*)?\Z", before)
        opened = max((a for a, b in pairs.items() if called and b == called.start()), default=None)
        function = opened is not None and not control.search(code[:opened].rstrip())
        if before.endswith("=>") or function or re.search(r"\bclass\b[^{};]*\Z", before):
            bodies.append((left, right))
    nested = [b for b in bodies if sum(a < b[0] and b[1] <= c for a, c in bodies) == 1]
    for left, right in sorted(nested, reverse=True):
        lines = source.count("\n", left, right + 1) - 1
        if lines > 1:
            source = source[:left] + K.TS_ELISION.format(n=lines) + source[right + 1:]
    return source


@F.pandas_udf(T.StringType())
def elide(source: pd.Series, language: pd.Series) -> pd.Series:
    """Replace the bodies of the outermost nested definitions by a marker (multi-line bodies only)."""
    return pd.Series([s if s is None or not s.strip() else
                      (_elide_script if lang == "typescript" else _elide_python)(s)
                      for s, lang in zip(source, language)])


# -- lines ---------------------------------------------------------------------------------------------

def _indent(line: Column) -> Column:
    return F.char_length(F.regexp_extract(line, r"(?U)^\s*", 0))


def _blank(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*\z")


def _statement_starts(lines: Column) -> Column:
    """Line numbers (0-based, never 0) at which a top-level statement of the body starts."""
    rest = F.filter(F.slice(lines, 2, F.size(lines)), lambda l: ~_blank(l))
    least = F.coalesce(F.array_min(F.transform(rest, _indent)), F.lit(0))
    numbered = F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i")))
    return X.let(least, lambda least: F.transform(F.filter(
        numbered, lambda x: (x["i"] > 0) & ~_blank(x["l"]) & (_indent(x["l"]) == least)), lambda x: x["i"]))


def _marked_lines(body: Column) -> Column:
    """`struct(l, cost, start)` per line: its text, its token cost, whether a statement starts there."""
    return X.let(F.split(body, "\n"), lambda lines: X.let(
        F.map_from_entries(F.transform(_statement_starts(lines), lambda i: F.struct(i, F.lit(True)))),
        lambda starts: F.transform(lines, lambda l, i: F.struct(
            l.alias("l"), (X.token_count(l) + 1).alias("cost"), F.coalesce(
                F.try_element_at(starts, i), F.lit(False)).alias("start")))))


def overflow_parts(body: Column, header: Column, cap: int = K.CHUNK_OVERFLOW_TOKENS) -> Column:
    """A body over `cap` tokens, cut before top-level statements, the header repeated on each part."""
    whole = F.concat_ws("\n", header, body)
    return F.when(X.token_count(whole) <= cap, F.array(whole)).otherwise(X.let(
        F.struct(_marked_lines(body).alias("lines"), (X.token_count(header) + 1).alias("head")),
        lambda v: F.transform(_cut_lines(v["lines"], v["head"], cap), lambda p: F.concat_ws("\n", header, p))))


def _cut_lines(lines: Column, head: Column, cap: int) -> Column:
    """Part texts: first the line ranges (a fold over costs), then one slice per range."""
    ints = F.array().cast("array<int>")
    state = F.struct(ints.alias("cuts"), F.lit(0).alias("i"), F.lit(0).alias("held"), head.alias("running"))

    def step(acc, x):
        split_here = (acc["running"] + x["cost"] > cap) & (acc["held"] > 0) & x["start"]
        return F.struct(
            F.when(split_here, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts"),
            (acc["i"] + 1).alias("i"), F.when(split_here, 1).otherwise(acc["held"] + 1).alias("held"),
            F.when(split_here, head + x["cost"]).otherwise(acc["running"] + x["cost"]).cast("int").alias("running"))

    bounds = F.aggregate(lines, state, step, lambda acc: F.concat(F.array(F.lit(0)), acc["cuts"], F.array(F.size(lines))))
    return X.let(bounds, lambda b: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda lo, k: F.array_join(F.transform(
        F.slice(lines, lo + 1, F.get(b, k + 1) - lo), lambda x: x["l"]), "\n")))


def truncated(header: Column, body: Column, language: Column, budget: int) -> Column:
    """A body cut at a statement start within `budget`, with a marker saying how much is shown."""
    total = F.size(F.split(body, "\n"))
    script = language == "typescript"

    def marker(count):
        python = F.format_string(K.TRUNCATION.replace("{shown}", "%s").replace("{total}", "%s"), count, total)
        ts = F.format_string(K.TS_TRUNCATION.replace("{shown}", "%s").replace("{total}", "%s"), count, total)
        return F.when(script, ts).otherwise(python)

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("stop"))

    def fitting(v):
        def step(acc, x):
            full = acc["stop"] | (acc["used"] + x["cost"] > v["room"])
            return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + x["cost"]).cast("int").alias("used"),
                            F.when(full, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"), full.alias("stop"))

        return F.aggregate(v["lines"], start, step, lambda acc: acc["kept"])

    def kept(v, fits):
        starts = F.filter(F.transform(v["lines"], lambda x, i: F.when(x["start"] & (i <= fits), i)), lambda i: i.isNotNull())
        back = F.coalesce(F.array_max(starts), F.lit(0))
        return F.greatest(F.lit(1), F.when(fits >= total, total).otherwise(back))

    room = F.lit(budget) - (X.token_count(header) + 1) - (X.token_count(marker(total)) + 1)
    ready = F.struct(_marked_lines(body).alias("lines"), room.alias("room"))
    return X.let(ready, lambda v: X.let(fitting(v), lambda fits: X.let(kept(v, fits), lambda n: F.concat_ws(
        "\n", header, F.array_join(F.transform(F.slice(v["lines"], F.lit(1), n), lambda x: x["l"]), "\n"), marker(n)))))


# -- the packer ---------------------------------------------------------------------------------------------

PACKED = "array<struct<uid:string,role:string,level:string,cost:int>>"


def _fold_seeds(seeds: Column, seed_cap: int, per_seed: int) -> Column:
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast(PACKED).alias("out"))

    def step(acc, s):
        fits = lambda cost: (cost <= per_seed) & (acc["used"] + cost <= seed_cap)
        level = (F.when(fits(s["full_cost"]), "full").when(fits(s["elided_cost"]), "elided")
                 .when(acc["n"] == 0, "truncated").otherwise("dropped"))
        cost = (F.when(level == "full", s["full_cost"]).when(level == "elided", s["elided_cost"])
                .when(level == "truncated", s["cut_cost"]).otherwise(0)).cast("int")
        row = F.struct(s["uid"].alias("uid"), F.lit("seed").alias("role"), level.alias("level"), cost.alias("cost"))
        return F.struct((acc["used"] + cost).cast("int").alias("used"),
                        (acc["n"] + (level != "dropped").cast("int")).alias("n"),
                        F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(seeds, start, step)


def _fold_stubs(stubs: Column, held: Column, cap: int) -> Column:
    start = F.struct(F.lit(0).alias("used"), F.array().cast(PACKED).alias("out"))

    def step(acc, s):
        known = F.exists(held, lambda h: (h["uid"] == s["uid"]) & (h["level"] != "dropped")) | F.exists(
            acc["out"], lambda h: (h["uid"] == s["uid"]) & (h["level"] != "dropped"))
        over = acc["used"] + s["stub_cost"] > cap
        row = F.struct(s["uid"].alias("uid"), F.lit("neighbor").alias("role"),
                       F.when(over, "dropped").otherwise("stub").alias("level"),
                       F.when(over, 0).otherwise(s["stub_cost"]).cast("int").alias("cost"))
        return F.when(known, acc).otherwise(F.struct(
            F.when(over, acc["used"]).otherwise(acc["used"] + s["stub_cost"]).cast("int").alias("used"),
            F.concat(acc["out"], F.array(row)).alias("out")))

    return F.aggregate(stubs, start, step)


def rendered(blocks: DataFrame, per_seed: int) -> DataFrame:
    """Adds the texts of every level a block can take, with their costs."""
    header = X.context_header(F.col("rel_path"), F.col("enclosing_signature"), F.col("signature"), F.col("used_imports"))
    seed = F.col("role") == "seed"
    out = blocks.withColumn("header", header).withColumn("language", X.language_of(F.col("rel_path")))
    out = out.withColumn("full_text", F.when(seed, F.concat_ws("\n", "header", "source_code")))
    out = out.withColumn("full_cost", F.when(seed, X.token_count(F.col("full_text"))).otherwise(0))
    # Only seeds over the cap are parsed again for their elided form.
    heavy = seed & (F.col("full_cost") > per_seed)
    out = out.withColumn("elided", elide(F.when(heavy, F.col("source_code")), F.col("language")))
    out = out.withColumn("elided_text", F.when(heavy, F.concat_ws("\n", "header", "elided")).otherwise(F.col("full_text")))
    out = out.withColumn("elided_cost", F.when(heavy, X.token_count(F.col("elided_text"))).otherwise(F.col("full_cost")))
    huge = heavy & (F.col("elided_cost") > per_seed)
    out = out.withColumn("cut_text", F.when(huge, truncated(F.col("header"), F.col("elided"), F.col("language"), per_seed)))
    out = out.withColumn("cut_cost", F.when(huge, X.token_count(F.col("cut_text"))).otherwise(0))
    out = out.withColumn("stub_text", F.when(~seed, X.stub(F.col("header"), F.col("signature"), F.col("docstring"))))
    return out.withColumn("stub_cost", F.when(~seed, X.token_count(F.col("stub_text"))).otherwise(0))


def pack(blocks: DataFrame, available: int = K.AVAILABLE, seed_share: float = K.SEED_SHARE,
         max_seed_frac: float = K.MAX_SEED_FRAC) -> DataFrame:
    """`question_id, position, handle, uid, role, level, cost, text`; dropped blocks have no handle.

    `blocks(question_id, uid, role, score, rel_path, enclosing_signature, signature, docstring,
    source_code, used_imports)`.  Greedy by (score desc, uid): seeds full, else elided, else dropped
    (the first one is cut instead when nothing was packed yet); then neighbours as stubs."""
    return fold(rendered(blocks, per_seed(available, seed_share, max_seed_frac)), available, seed_share, max_seed_frac)


def per_seed(available: int, seed_share: float = K.SEED_SHARE, max_seed_frac: float = K.MAX_SEED_FRAC) -> int:
    """Tokens that one seed may take."""
    return int(int(available * seed_share) * max_seed_frac)


def fold(ready: DataFrame, available: int = K.AVAILABLE, seed_share: float = K.SEED_SHARE, max_seed_frac: float = K.MAX_SEED_FRAC) -> DataFrame:
    """`pack` of blocks that are rendered already."""
    seed_cap = int(available * seed_share)
    most = per_seed(available, seed_share, max_seed_frac)
    costs = F.struct((-F.col("score")).alias("o"), "uid", "full_cost", "elided_cost", "cut_cost", "stub_cost")
    listed = ready.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "seed", costs))).alias("seeds"),
        F.sort_array(F.collect_list(F.when(F.col("role") != "seed", costs))).alias("stubs"))
    folded = listed.withColumn("s", _fold_seeds(F.col("seeds"), seed_cap, most)).withColumn(
        "t", X.let(F.col("s.out"), lambda held: _fold_stubs(F.col("stubs"), held, available - seed_cap)))
    every = F.concat("s.out", "t.out")
    kept = F.filter(every, lambda b: b["level"] != "dropped")
    gone = F.filter(every, lambda b: b["level"] == "dropped")
    rows = folded.select("question_id", F.posexplode(F.concat(kept, gone)).alias("p", "b"), F.size(kept).alias("n"))
    placed = rows.select(
        "question_id", (F.col("p") + 1).alias("position"),
        F.when(F.col("p") < F.col("n"), F.concat(F.lit("C"), (F.col("p") + 1).cast("string"))).alias("handle"),
        "b.uid", "b.role", "b.level", "b.cost")
    texts = ready.select("question_id", "uid", "role", "full_text", "elided_text", "cut_text", "stub_text")\
        .dropDuplicates(["question_id", "uid", "role"])
    text = (F.when(F.col("level") == "full", F.col("full_text")).when(F.col("level") == "elided", F.col("elided_text"))
            .when(F.col("level") == "truncated", F.col("cut_text")).when(F.col("level") == "stub", F.col("stub_text")))
    return placed.join(texts, ["question_id", "uid", "role"]).withColumn("text", text).select(
        "question_id", "position", "handle", "uid", "role", "level", "cost", "text")


def packing_report(packed: DataFrame, available: int = K.AVAILABLE) -> DataFrame:
    """Counts per level, tokens, drop rate and the one-line summary, per question."""
    count = lambda level: F.count_if(F.col("level") == level)
    out = packed.groupBy("question_id").agg(
        *[count(l).alias(l) for l in ("full", "elided", "truncated", "stub", "dropped")],
        F.sum("cost").alias("tokens"), F.count(F.lit(1)).alias("total"))
    part = lambda c, words: F.when(F.col(c) > 0, F.format_string(f"%d {words}", F.col(c)))
    summary = F.concat(F.lit("Context: "), F.concat_ws(
        ", ", F.format_string("%d of %d results in full", F.col("full"), F.col("total")), part("elided", "elided"),
        part("truncated", "truncated"), part("stub", "as signatures"), part("dropped", "omitted")),
        F.format_string(f" (%.1fk / {available / 1000:.1f}k tokens)", F.col("tokens") / 1000.0))
    return out.withColumn("drop_rate", F.col("dropped") / F.col("total")).withColumn("summary", summary)


def prompt(question: Column, context: Column, report: Column, reminder: Column | None = None) -> Column:
    return F.concat_ws("\n\n", question, context, report, *([reminder] if reminder is not None else []))


def promoted(blocks: DataFrame, dropped: DataFrame) -> DataFrame:
    """Blocks dropped last time come first: they get a score above every other of their question."""
    top = blocks.groupBy("question_id").agg(F.max("score").alias("_top"))
    flag = dropped.select("question_id", "uid").distinct().withColumn("_up", F.lit(True))
    out = blocks.join(flag, ["question_id", "uid"], "left").join(top, "question_id")
    return out.withColumn("score", F.when(F.col("_up"), F.col("_top") + 1.0).otherwise(F.col("score"))).withColumn(
        "role", F.when(F.col("_up"), "seed").otherwise(F.col("role"))).drop("_up", "_top")
