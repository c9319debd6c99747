"""Hard gates, fusion of several judges' votes, and statistics over votes.

Votes are rows (qid, model, passed, final_score, realism, dual_use, correctness). Missing passed counts as no,
missing scores as 0, as the gates' zero result does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqa.functions import text as T

SUBSCORES = ("realism", "dual_use", "correctness")


def gate_reasons(question: Column, answer: Column, source_id: Column, target_id: Column, forbid_in_question: Column, forbid_in_answer: Column) -> Column:
    """Why an item fails before any judge is asked; empty where it passes."""
    reasons = F.array(
        F.when(~T.has_tags(answer, source_id, target_id), "missing_required_tags"),
        F.when(forbid_in_question & T.has_judge_citation(question), "forbidden_citation_in_question"),
        F.when(forbid_in_answer & T.has_judge_citation(answer), "forbidden_citation_in_answer"),
    )
    found = F.array_compact(reasons)
    return F.when(F.size(found) > 0, F.concat(F.array(F.lit("local_hard_gate_fail")), found)).otherwise(found)


def passes(models: list[str], seed: int, second_seed: int | None = None) -> list[tuple[str, int, str]]:
    """(model, seed, tag) of every judge pass: each model with the seed, and the first once more with the second seed."""
    found = [(m, seed, f"{m}@seed:{seed}") for m in models]
    if second_seed is not None:
        found.append((models[0], second_seed, f"{models[0]}@seed:{second_seed}"))
    return found


def expand_passes(qas: DataFrame, models: list[str], seed: int, second_seed: int | None = None) -> DataFrame:
    """Each QA once for each judge pass, in pass order."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.lit(t).alias("tag")) for m, s, t in passes(models, seed, second_seed)])
    return qas.select("*", F.posexplode(each).alias("pass_no", "p")).select(*qas.columns, "pass_no", "p.*")


def median_int(x: Column) -> Column:
    """The median rounded half to even, as an int."""
    return F.bround(F.median(x), 0).cast("int")


def fuse(votes: DataFrame, least_dual_use: int = 2) -> DataFrame:
    """One row a QA: median scores, majority of passed; a tie passes if at least ``least_dual_use`` judges give dual_use 3
    or more and the yes-voters' median score is not below the no-voters'."""
    passed = F.coalesce("passed", F.lit(False))
    score = F.coalesce("final_score", F.lit(0))
    v = votes.select("qid", passed.alias("passed"), score.alias("final_score"), *[F.coalesce(s, F.lit(0)).alias(s) for s in SUBSCORES])
    g = v.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("yes"), F.count_if(F.col("dual_use") >= 3).alias("k"),
        median_int(F.col("final_score")).alias("final_score"), *[median_int(F.col(s)).alias(s) for s in SUBSCORES],
        F.coalesce(F.median(F.when(F.col("passed"), F.col("final_score"))), F.lit(0.0)).alias("med_yes"),
        F.coalesce(F.median(F.when(~F.col("passed"), F.col("final_score"))), F.lit(0.0)).alias("med_no"),
    )
    no = F.col("n") - F.col("yes")
    tie, enough = F.col("yes") == no, F.col("k") >= least_dual_use
    decided = F.when(~tie, F.col("yes") > no).otherwise(enough & (F.col("med_yes") >= F.col("med_no")))
    reason = (
        F.when(tie & enough, F.concat(F.lit("tie_break_dual_use_k="), F.col("k").cast("string"), F.lit(f">={least_dual_use}")))
        .when(tie, F.concat(F.lit("tie_break_failed_dual_use_k="), F.col("k").cast("string"), F.lit(f"<{least_dual_use}")))
    )
    return g.select("qid", "n", decided.alias("passed"), "final_score", *SUBSCORES, F.array_compact(F.array(F.lit("fused_median_scores_over_ensemble"), reason)).alias("reasons"))


def iqr(values: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., iqr): median of the upper half less median of the lower half, the middle left out for odd n; 0 below two values.

    Values are counted first and found by running counts, so a group of any size moves only its distinct values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("c").over(over.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(over))
    half = F.floor(F.col("n") / 2)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    low, high = F.floor((half - 1) / 2), F.floor(half / 2)
    found = run.groupBy(*by).agg((at(F.col("n") - half + low) + at(F.col("n") - half + high) - at(low) - at(high)).alias("twice"), F.max("n").alias("n"))
    return found.select(*by, F.when(F.col("n") < 2, 0.0).otherwise(F.col("twice") / 2).alias("iqr"))


def score_stats(fused: DataFrame, *by: str) -> DataFrame:
    """n, passed, share, and mean, median, population deviation and IQR of the final score; means of subscores."""
    score = F.col("final_score").cast("double")
    stats = fused.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"),
        F.round(100 * F.count_if("passed") / F.count(F.lit(1)), 6).alias("pass_pct"),
        F.round(F.avg(score), 6).alias("mean"), F.round(F.median(score), 6).alias("median"),
        F.round(F.coalesce(F.stddev_pop(score), F.lit(0.0)), 6).alias("std"),
        *[F.round(F.avg(s), 6).alias(f"mean_{s}") for s in SUBSCORES],
    )
    return stats.join(iqr(fused, "final_score", *by), list(by))


def agreement(votes: DataFrame) -> DataFrame:
    """One row: items, unanimous yes, unanimous no, and two-to-one among exactly three."""
    each = votes.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("passed", F.lit(False))).alias("yes"))
    no = F.col("n") - F.col("yes")
    return each.agg(
        F.count(F.lit(1)).alias("items"), F.count_if((no == 0) & (F.col("yes") > 0)).alias("unanimous_yes"), F.count_if(F.col("yes") == 0).alias("unanimous_no"),
        F.count_if((F.col("n") == 3) & (F.greatest("yes", no) == 2)).alias("two_to_one"),
    )


def pass_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """kept, eliminated and pass share for each single key and in total, in one pass by grouping sets."""
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = items.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        *[F.grouping(k).alias(f"_{k}") for k in keys], F.count_if("passed").alias("kept"), F.count_if(~F.col("passed")).alias("eliminated"), F.count(F.lit(1)).alias("n")
    )
    dimension = F.coalesce(*[F.when(F.col(f"_{k}") == 0, k) for k in keys], F.lit("total"))
    value = F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("ALL"))
    share = F.round(100 * F.col("kept") / F.greatest(F.lit(1), F.col("n")), 6)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "kept", "eliminated", share.alias("pass_pct"))
