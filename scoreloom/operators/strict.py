"""Joins that must hold: every rule is checked by the plan of the join itself, so nothing is scanned or shuffled a second time.

The right side is reduced to one row per key with the number of its copies before it is shuffled, which is the partitioning that the
join needs. Faulty rows either make the job fail at the first one (``raise_error`` in a filter, which no optimiser removes), or are
kept with the name of their fault; ``observed`` counts them as the rows pass by.

Faults of a key: ``unused`` (only on the right, where ``cover`` asks for equal key sets), ``missing`` (only on the left), ``repeated`` (more
than once on a side that must be unique), ``changed`` (a column of ``agree`` differs). A key that is null or has a null part matches
nothing. Payloads of the right are null where its key is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scoreloom.operators.skew import SALTS

FAULTS = ["missing", "unused", "repeated", "changed"]


def _unique(rows: DataFrame, on: list[str], mark: str) -> DataFrame:
    """One row per key: the other columns as a struct, and how often the key occurs."""
    rest = [c for c in rows.columns if c not in on]
    held = F.any_value(F.struct(*rest)) if rest else F.any_value(F.struct(F.lit(1).alias("_")))
    return rows.groupBy(*on).agg(F.count("*").alias(f"_{mark}"), held.alias(f"_{mark}_row"))


def strict_join(left: DataFrame, right: DataFrame, on: list[str], *, one_to_one: bool = False, cover: bool = False, agree: list[str] | None = None, fault: str = "raise", name: str = "join", hot: Column | None = None) -> DataFrame:
    """``left`` with the columns of ``right``; every left row must have exactly one right row, and with ``one_to_one`` no two left
    rows may share it. ``cover``: every right key must be used. ``agree``: columns of both sides that must be equal (nulls agree).

    ``fault`` "raise": the job fails at a faulty row. "keep": all rows come back with a column ``fault``, null where all is well.
    ``hot``: true for left rows whose key has a large share of all rows; they are dealt over several tasks (a plain N:1 join leaves
    that to adaptive execution, which cannot split the outer join that ``cover`` needs).
    """
    agree = agree or []
    rest = [c for c in right.columns if c not in (*on, *agree)]
    if clash := sorted(set(rest) & set(left.columns) | {"fault"} & {*left.columns, *rest}):
        raise ValueError(f"{name}: columns of both sides or reserved: {clash}")
    if missing := [c for c in agree if c not in left.columns or c not in right.columns]:
        raise ValueError(f"{name}: not on both sides: {missing}")
    r = _unique(right, on, "right")
    own = [c for c in left.columns if c not in on]
    if one_to_one:
        l, value = _unique(left, on, "left"), lambda c: F.col(f"_left_row.{c}")  # noqa: E741
    else:
        l, value = left.withColumn("_left", F.lit(1).cast("long")), F.col  # noqa: E741
    if hot is not None and cover and not one_to_one:
        spread = F.coalesce(hot, F.lit(False))
        l = l.withColumn("_salt", F.when(spread, F.pmod(F.xxhash64(*[F.col(c) for c in own]), F.lit(SALTS))).otherwise(0).cast("int"))  # noqa: E741
        r = r.withColumn("_salt", F.explode(F.when(F.coalesce(hot, F.lit(False)), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        both = l.join(r, [*on, "_salt"], "full_outer").where(F.col("_left").isNotNull() | ~F.coalesce(hot, F.lit(False))).drop("_salt")
    else:
        both = l.join(r, on, "full_outer" if cover else "left")
    differs = F.lit(False)
    for c in agree:
        differs = differs | ~value(c).eqNullSafe(F.col(f"_right_row.{c}"))
    found = (
        F.when(F.col("_left").isNull(), "unused").when(F.col("_right").isNull(), "missing")
        .when((F.col("_left") > 1) | (F.col("_right") > 1), "repeated").when(differs, "changed")
    )
    single = F.col("_right") == 1
    columns = [*[F.col(c) for c in on], *[value(c).alias(c) for c in own], *[F.when(single, F.col(f"_right_row.{c}")).alias(c) for c in rest], found.alias("fault")]
    joined = both.select(*columns)
    return joined if fault == "keep" else refuse(joined, F.col("fault").isNotNull(), F.concat_ws(" ", F.lit(f"{name}:"), "fault", F.to_json(F.struct(*on)))).drop("fault")


def refuse(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The same rows; the job that reads them fails at the first bad one."""
    return rows.where(F.when(bad, F.raise_error(message)).isNull())


def out_of_scope(scope: dict[str, list]) -> Column:
    """Names of the columns whose value is not among the allowed ones (null never is), joined by ``;``, or null."""
    faults = F.concat_ws(";", *[F.when(~F.coalesce(F.col(c).isin(allowed), F.lit(False)), F.lit(c)) for c, allowed in scope.items()])
    return F.when(faults != "", faults)


def in_scope(rows: DataFrame, scope: dict[str, list], name: str) -> DataFrame:
    """The same rows; the job fails at the first one outside ``scope`` (train only, formal runs only and the like)."""
    return refuse(rows, out_of_scope(scope).isNotNull(), F.concat(F.lit(f"{name}: out of scope in "), out_of_scope(scope)))


class Watch:
    """Counts faults and mixed identities of rows as a job reads them; ``settle`` speaks after that job."""

    def __init__(self, name: str, single: list[str] | None = None):
        self.name, self.single = name, single or []
        self._seen = Observation(name)

    def over(self, rows: DataFrame) -> DataFrame:
        counts = [F.count_if(F.col("fault") == f).alias(f) for f in FAULTS] if "fault" in rows.columns else []
        ends = [F.to_json(g(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))))).alias(f"{c}_{e}") for c in self.single for e, g in (("lo", F.min), ("hi", F.max))]
        return rows.observe(self._seen, F.count("*").alias("rows"), *counts, *ends)

    def counts(self) -> dict[str, int]:
        return {k: v for k, v in self._seen.get.items() if k in ("rows", *FAULTS)}

    def settle(self) -> dict[str, int]:
        """Counts by fault; an error if there are any, or if a column of ``single`` had more than one value."""
        seen = self._seen.get
        mixed = [c for c in self.single if seen[f"{c}_lo"] != seen[f"{c}_hi"]]
        bad = {k: v for k, v in self.counts().items() if k != "rows" and v}
        if mixed or bad:
            raise ValueError(f"{self.name}: " + ", ".join([*(f"mixed {c}" for c in mixed), *(f"{v} {k}" for k, v in bad.items())]))
        return self.counts()


def unequal_sets(rows: DataFrame, group: str, member: str, groups: list[str]) -> DataFrame:
    """Members that not all of ``groups`` have exactly once, with the groups that lack or repeat them: one aggregation by member and
    group, then one by member, which holds no more than the groups; no set is compared with another."""
    per = rows.groupBy(member, group).agg(F.count("*").alias("n"))
    found = per.groupBy(member).agg(F.array_sort(F.collect_list(group)).alias("_have"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("n") > 1, F.col(group))))).alias("_again"))
    every = F.array_sort(F.array(*[F.lit(g) for g in groups]))
    lacking = F.array_join(F.array_except(every, "_have"), ";").alias("lacking")
    return found.select(member, lacking, F.array_join("_again", ";").alias("repeated"), F.array_join(F.array_except("_have", every), ";").alias("foreign")).where("lacking <> '' OR repeated <> '' OR foreign <> ''")


def policy_packages(checkpoints: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Checkpoints (checkpoint_id, checkpoint_hash) with their calibration (checkpoint_id, checkpoint_hash, status, stop_boundary,
    coverage, failure_reason), one to one and of the same hash: all of them, with what of the calibration counts. A success is
    promoted with its boundary frozen; a failure keeps its reason and has no boundary. Faulty keys are rows with ``fault``."""
    joined = strict_join(checkpoints, calibrations, ["checkpoint_id"], one_to_one=True, cover=True, agree=["checkpoint_hash"], fault="keep", name="policy packages")
    status = F.when(F.col("fault").isNull() & ~F.coalesce(F.col("status").isin("success", "failure"), F.lit(False)), "illegal_status").otherwise(F.col("fault"))
    good = F.col("fault").isNull() & (F.col("status") == "success")
    sound = F.col("fault").isNull()
    reason = F.when(F.coalesce(F.col("failure_reason"), F.lit("")) == "", "unknown_calibration_failure").otherwise(F.col("failure_reason"))
    return joined.withColumn("fault", status).select(
        "checkpoint_id", F.when(sound, F.concat(F.lit("pkg_"), F.col("checkpoint_id").cast("string"))).alias("package_id"), F.when(sound, F.col("checkpoint_hash")).alias("checkpoint_hash"), "fault",
        F.when(sound, F.coalesce(good, F.lit(False))).alias("promoted"), F.when(good, F.col("stop_boundary")).alias("stop_boundary"), F.when(sound, F.coalesce(F.col("coverage"), F.lit(0.0))).alias("coverage"),
        F.when(sound, F.when(good, "").otherwise(reason)).alias("failure_reason"),
    )
