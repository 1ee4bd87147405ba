"""Evaluation cases: histories and what is to be found, and systems held against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from . import core, metrics

#: Which domain a task asks for; None is any.
TARGETS = {"within_movie": "movie", "within_game": "game", "movie_to_game": "game", "game_to_movie": "movie", "mixed": None, "cold_start": None}
#: Hold-out groups whose users are asked across domains: the later two of four.
CROSS_GROUPS = (2, 3)


def eval_tables(inter: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``history`` (task, user_id and the columns of ``inter``), ``relevant`` (task, user_id, item_id) and ``seen``, what a
    task's lists leave out (the same columns).

    Users outside the hold-out groups are asked for the positives of their last rows: inside a domain from that domain's
    history, in both from a history with positives in both, and with no history at all but seen items left out. Hold-out
    users are asked for the positives of the domain that is hidden. A case needs something to find, and positives in its
    history (or, with no history, among the seen). ``cap`` keeps so many users of each task, by hash.
    """
    inter = materialise(inter)  # every task reads it again
    grp = metrics.holdout_groups(inter)
    parts = materialise(core.chronological_split(inter).join(grp.select("user_id"), "user_id", "left_anti"))
    known, later = parts.where("part <> 'test'").drop("part"), core.positives(parts.where("part = 'test'")).drop("part")
    tag = lambda df, task: df.withColumn("task", F.lit(task))
    both = core.positives(known).groupBy("user_id").agg(F.countDistinct("domain").alias("n")).where("n = 2").select("user_id")
    asked = inter.join(grp, "user_id").where(F.col("grp").isin(*CROSS_GROUPS)).withColumn("from", F.when(F.col("grp") % 2 == 0, "movie").otherwise("game")).drop("grp")
    kept, hidden = asked.where("domain = from").drop("from"), core.positives(asked.where("domain <> from")).drop("from")
    history, relevant, seen = [], [], []
    for d in core.DOMAINS:
        one = known.where(F.col("domain") == d)
        history.append(tag(one, f"within_{d}"))
        relevant.append(tag(later.where(F.col("domain") == d), f"within_{d}"))
        other = "game" if d == "movie" else "movie"
        history.append(tag(kept.where(F.col("domain") == d), f"{d}_to_{other}"))
        relevant.append(tag(hidden.where(F.col("domain") == other), f"{d}_to_{other}"))
    history.append(tag(known.join(both, "user_id", "left_semi"), "mixed"))
    relevant += [tag(later.join(both, "user_id", "left_semi"), "mixed"), tag(later, "cold_start")]
    cold = tag(known, "cold_start")
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    history, relevant = union(history), union(relevant)
    seen = history.unionByName(cold)
    able = core.positives(seen).select("task", "user_id").distinct().join(relevant.select("task", "user_id").distinct(), ["task", "user_id"])
    if cap is not None:
        order = F.md5(F.concat_ws("|", F.lit("case"), "task", F.col("user_id").cast("string")).cast("binary"))
        able = core.top(able, ["task"], cap, order, "user_id").select("task", "user_id")
    able = materialise(able)  # for all three tables
    keep = lambda df: df.join(able, ["task", "user_id"], "left_semi")
    key = ["task", "user_id", "item_id"]
    return keep(history), keep(relevant).select(*key), keep(seen).select(*key)


def benchmark(systems: dict[str, Callable[[DataFrame], DataFrame]], cases: tuple[DataFrame, DataFrame, DataFrame], items: DataFrame, segments: DataFrame, k: int = 10) -> DataFrame:
    """``system, task, segment`` with the mean of each metric, ``n`` cases and ``coverage``, the share of all items in the lists.

    A system takes ``(case, task, user_id)`` of the cases and returns ``case, item_id, score``; cases for which it has no
    item aren't counted for it. Lists hold items of the task's domain that the user hasn't seen. ``segments`` has user_id
    and segment.
    """
    history, relevant, seen = cases
    case = F.concat_ws("|", "task", F.col("user_id").cast("string")).alias("case")
    target = F.coalesce(*[F.when(F.col("task") == t, F.lit(d)) for t, d in TARGETS.items() if d])
    asked = relevant.select(case, "task", "user_id", target.alias("target")).distinct()
    known = seen.select(case, "item_id")
    lists = None
    for name, system in systems.items():
        rows = system(asked).join(asked.select("case", "target"), "case").join(items.select("item_id", "domain"), "item_id").where("target is null or domain = target").join(known, ["case", "item_id"], "left_anti")
        one = core.top(rows, ["case"], k, F.desc("score"), "item_id").select(F.lit(name).alias("system"), "case", "item_id", "rank")
        lists = one if lists is None else lists.unionByName(one)
    lists = materialise(lists)
    run = F.concat_ws("#", "system", "case").alias("user_id")
    answered = lists.select("system", "case").distinct()
    wanted = answered.join(relevant.select(case, "item_id"), "case")
    scored = metrics.ranking_metrics(lists.select(run, "item_id", "rank"), wanted.select(run, "item_id"), k)
    tagged = answered.join(asked, "case").join(segments, "user_id").select(run.alias("run"), "system", "case", "task", "segment")
    names = ["ndcg", "recall", "hit", "map"]
    means = tagged.join(scored, F.col("run") == F.col("user_id")).groupBy("system", "task", "segment").agg(*[F.avg(m).alias(m) for m in names], F.count("*").alias("n"))
    total = items.agg(F.count("*").alias("total"))  # one row
    covered = tagged.join(lists, ["system", "case"]).groupBy("system", "task", "segment").agg(F.countDistinct("item_id").alias("shown")).crossJoin(F.broadcast(total))
    return means.join(covered.select("system", "task", "segment", (F.col("shown") / F.col("total")).alias("coverage")), ["system", "task", "segment"])
