"""Choosing references, champions and packages: relational division, lexicographic minima, replayed policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reference_policies(evaluations: DataFrame, budgets: list[str]) -> DataFrame:
    """Per budget the admissible policy with the least (severe, unsafe, nmae, -qwk, cost, elapsed, calls, exchanges, id); a row without a policy
    and with a reason where none is admissible."""
    key = F.struct("worst_severe", "worst_unsafe", "nmae", -F.col("qwk"), "cost", "elapsed", "calls", "exchanges", "policy")
    best = evaluations.where(F.col("ready") & F.col("feasible")).groupBy("budget").agg(F.min_by("policy", key).alias("policy"), F.count("*").alias("eligible"))
    every = evaluations.sparkSession.createDataFrame([(b,) for b in budgets], "budget string")
    return every.join(best, "budget", "left").select("budget", "policy", F.coalesce("eligible", F.lit(0)).cast("long").alias("eligible"), F.when(F.col("policy").isNull(), "no_eligible_policy").otherwise("selected").alias("status"))


def admitted(evaluations: DataFrame, gates: DataFrame, budgets: list[str]) -> DataFrame:
    """Packages that are feasible and pass their fixed gate at every budget, and the reasons of the others."""
    e = evaluations.join(gates, ["package", "budget"], "left")
    ok = F.col("feasible") & F.coalesce(F.col("gate") == "pass", F.lit(False))
    reason = F.when(~F.col("feasible"), "infeasible").when(F.col("gate").isNull(), "gate_missing").when(F.col("gate") != "pass", F.concat(F.lit("gate_"), F.col("gate")))
    per = e.groupBy("package").agg(F.count_if(ok).alias("passed"), F.array_join(F.array_sort(F.array_compact(F.collect_set(F.concat_ws(":", "budget", reason)))), ";").alias("why"))
    whole = F.col("passed") == len(budgets)
    return per.select("package", whole.alias("admitted"), F.when(whole, "").otherwise(F.col("why")).alias("reasons"))


def champion(quality: DataFrame, names: DataFrame) -> DataFrame:
    """The admitted package of the best quality over all budgets. ``quality`` must not carry any resource column."""
    if banned := {"cost", "elapsed", "calls", "exchanges"} & set(quality.columns):
        raise ValueError(f"the champion is chosen without {sorted(banned)}")
    per = quality.join(names, "package", "left_semi").groupBy("package").agg(F.max("worst_severe").alias("s"), F.max("worst_unsafe").alias("u"), F.sum("nmae").alias("e"), F.sum("qwk").alias("q"))
    return per.agg(F.min_by("package", F.struct("s", "u", "e", -F.col("q"), "package")).alias("champion"))


def select_package(evaluations: DataFrame, gates: DataFrame, protection: DataFrame, budgets: list[str]) -> DataFrame:
    """(package, admitted, reasons, champion, protected, selected): admission, then quality alone, then resources among the
    champion and the packages that pass the gate against it (protection: package, comparator, budget, gate) at every budget."""
    rows = admitted(evaluations, gates, budgets)
    names = rows.where("admitted").select("package")
    best = champion(evaluations.select("package", "budget", "worst_severe", "worst_unsafe", "nmae", "qwk"), names)
    safe = protection.join(best, F.col("comparator") == F.col("champion")).groupBy("package").agg((F.count_if(F.col("gate") == "pass") == len(budgets)).alias("safe"))
    marked = rows.crossJoin(F.broadcast(best)).join(safe, "package", "left")  # one champion
    protected = F.col("admitted") & ((F.col("package") == F.col("champion")) | F.coalesce("safe", F.lit(False)))
    marked = marked.withColumn("protected", protected).withColumn("is_champion", F.coalesce(F.col("package") == F.col("champion"), F.lit(False)))
    use = evaluations.groupBy("package").agg(F.sum("cost").alias("cost"), F.sum("elapsed").alias("elapsed"), F.sum("calls").alias("calls"), F.sum("exchanges").alias("exchanges"))
    cheapest = marked.where("protected").join(use, "package").agg(F.min_by("package", F.struct("cost", "elapsed", "calls", "exchanges", "package")).alias("selected"))
    return marked.crossJoin(F.broadcast(cheapest)).select("package", "admitted", "reasons", F.col("is_champion").alias("champion"), "protected", F.coalesce(F.col("package") == F.col("selected"), F.lit(False)).alias("selected"))


def replay(outputs: DataFrame, policy: Column, boundary: int, limits: DataFrame) -> DataFrame:
    """Papers under a policy that names one agent per item: an item above the risk boundary costs one evidence call more
    without changing its score; a paper without any such item still pays one check. Feasible means within every limit."""
    chosen = outputs.where(F.col("agent") == policy)
    risky = F.col("risk") > boundary
    per = chosen.groupBy("paper_id").agg(F.count("*").alias("items"), F.sum("cost").alias("base"), F.count_if(risky).alias("escalations"), F.sum(F.when(risky, 1000).otherwise(0)).alias("extra"))
    calm = F.col("escalations") == 0
    papers = per.select("paper_id", "items", "escalations", (F.col("base") + F.col("extra") + F.when(calm, 100).otherwise(0)).alias("cost"), (F.col("items") + F.col("escalations") + F.when(calm, 1).otherwise(0)).alias("calls"))
    over = papers.crossJoin(F.broadcast(limits)).withColumn("within", (F.col("cost") <= F.col("max_cost")) & (F.col("calls") <= F.col("max_calls")))  # a few budgets
    return over.groupBy("budget").agg(F.count("*").alias("papers"), F.sum("cost").alias("cost"), F.sum("calls").alias("calls"), F.sum("escalations").alias("escalations"), F.count_if("within").alias("feasible_papers"), F.bool_and("within").alias("feasible"))
