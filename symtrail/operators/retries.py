"""The second attempt at an answer: blocks that were dropped move up, or the surroundings are widened, and only
what was not rendered before is rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from symtrail import constants as K
from symtrail.operators import packing

KEY = ["question_id", "uid", "role"]


def second_blocks(blocks: DataFrame, plan: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """Blocks of the second attempt of the questions in `plan` (question_id, action, uid).

    Promoted blocks come before all others as seeds; a question with any is not widened.  Else the blocks
    of `around` (as `blocks`, what stands near the plan's uids) join the neighbours, those that are
    there already excepted: these keep their scores."""
    asked = blocks.join(plan.select("question_id").distinct(), "question_id", "left_semi")
    out = packing.promoted(asked, plan.filter("action = 'promote'"))
    if around is None:
        return out
    widened = plan.filter("action = 'expand'").select("question_id").distinct()
    more = around.join(widened, "question_id", "left_semi").join(asked.select("question_id", "uid"), ["question_id", "uid"], "left_anti")
    best = more.withColumn("role", F.lit("neighbor")).dropDuplicates(["question_id", "uid"])
    return out.unionByName(best.select(*out.columns))


def repack(ready: DataFrame, blocks: DataFrame, available: int = K.AVAILABLE) -> DataFrame:
    """`blocks` packed as `packing.pack` would; a block that `ready` (`packing.rendered`) has in its role keeps
    its rendering, so only new blocks and those that change their role are rendered."""
    scores = blocks.select(*KEY, "score")
    kept = ready.drop("score").join(scores, KEY)
    new = packing.rendered(blocks.join(ready.select(*KEY), KEY, "left_anti"), packing.per_seed(available))
    return packing.fold(kept.unionByName(new.select(*kept.columns)), available)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the second context that the first did not show (by uid): all a prompt must add."""
    shown = lambda packed: packed.filter("handle is not null")
    return shown(after).join(shown(before).select("question_id", "uid"), ["question_id", "uid"], "left_anti")
