"""Manifests: digests of whole tables that combine without gathering, and what they say about a table that has changed.

A row's key is hashed, and its values are put into canonical JSON and hashed. Rows are dealt into buckets by the first digits of the
key's digest, so many that a bucket holds some thousand rows; a bucket's digest is that of its rows' digests in order. Sixteen
to the third buckets make one above, and so on up to a root. Every level is one aggregation of hashed keys with bounded groups, and two
tables are compared from the root down: only rows of buckets that differ are looked at one by one.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to a bucket, about, and digits that each level above adds.
BUCKET_ROWS, DIGITS = 2048, 3
#: Ids that are joined to one block of a component's digest.
BLOCK_IDS = 4096


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def canonical_row(columns: list[str]) -> Column:
    """A row as canonical JSON: keys in order, nulls kept. Values may be strings, whole numbers, booleans, or arrays and structs of
    these whose fields are in order; text that is JSON already goes through ``json_walk`` first."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, digest) of every row: digests of the key columns and of the other columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(sha256(canonical_row(keys)).alias("key"), sha256(canonical_row(rest) if rest else F.lit("{}")).alias("digest"))


def bucket_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hexadecimal digits of the lowest buckets, a multiple of DIGITS."""
    return 0 if rows <= bucket_rows else DIGITS * math.ceil(math.log(rows / bucket_rows, 16) / DIGITS)


def digest_tree(rows: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """(digits, bucket, rows, digest): all levels of the tree, the root with no digits and the empty bucket. Repeated keys count each."""
    leaves = row_digests(rows, keys)
    digits = bucket_digits(leaves.count()) if digits is None else digits
    together = lambda items: sha256(F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: F.concat_ws(":", x["key"], x["digest"])), "\n"))
    level = leaves.groupBy(F.substring("key", 1, digits).alias("bucket")).agg(F.count("*").alias("rows"), together(F.struct("key", "digest")).alias("digest")).checkpoint()
    out = level.select(F.lit(digits).alias("digits"), "bucket", "rows", "digest")
    while digits > 0:
        digits -= DIGITS
        level = level.groupBy(F.substring("bucket", 1, digits).alias("up")).agg(F.sum("rows").alias("rows"), together(F.struct(F.col("bucket").alias("key"), "digest")).alias("digest")).withColumnRenamed("up", "bucket")
        out = out.unionByName(level.select(F.lit(digits).alias("digits"), "bucket", "rows", "digest"))
    return out


def tampered(rows: DataFrame, manifest: DataFrame, keys: list[str], tree: DataFrame, digits: int) -> DataFrame:
    """(key, fault) of the rows that a manifest (key, digest: ``row_digests`` of the table as it was; tree: its ``digest_tree``) does not
    agree with: missing, added, changed, repeated. Only buckets whose digests differ are compared row by row."""
    lowest = lambda t: t.where(F.col("digits") == digits).select("bucket", "digest")
    now, was = lowest(digest_tree(rows, keys, digits)), lowest(tree).withColumnRenamed("digest", "was")
    differ = now.join(was, "bucket", "full_outer").where(~F.col("digest").eqNullSafe(F.col("was"))).select("bucket").checkpoint()
    inside = lambda t: t.withColumn("bucket", F.substring("key", 1, digits)).join(differ, "bucket", "left_semi")
    side = lambda t, s: inside(t).groupBy("key").agg(F.count("*").alias(f"{s}_n"), F.min("digest").alias(f"{s}_d"), F.max("digest").alias(f"{s}_e"))
    both = side(row_digests(rows, keys), "a").join(side(manifest, "b"), "key", "full_outer")
    same = (F.col("a_d") == F.col("b_d")) & (F.col("a_e") == F.col("b_e"))
    fault = F.when(F.col("a_n").isNull(), "missing").when(F.col("b_n").isNull(), "added").when(F.col("a_n") != F.col("b_n"), "repeated").when(~same, "changed")
    return both.select("key", fault.alias("fault")).where("fault IS NOT NULL")


# ---- rules of records, as arrays of the names of those that fail


def failing(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in order; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def is_text(c: str) -> Column:
    return F.trim(F.col(c).cast("string")) != ""


def is_digest(c: str) -> Column:
    return F.lower(F.trim(F.col(c))).rlike("^[0-9a-f]{64}$")


#: Names of splits, roles and statuses, prefixes and versions that manifests carry.
INTERNAL_SPLITS = ["train_fit", "train_calibration"]
COMPONENT_VERSION, COMPONENT_PREFIX = "internal_component_v1.4", "ic_"
PROTOCOL_HASHES = ["quality_protocol_hash", "internal_manifest_hash", "quality_reference_manifest_hash", "budget_manifest_hash", "support_manifest_hash"]


def split_record_rules() -> dict[str, Column]:
    """Rules of one row of a split manifest."""
    texts = ("item_id", "dataset", "prompt_group", "component_id", "source_split", "internal_split", "rule_version", "stable_hash")
    return {f"text:{c}": is_text(c) for c in texts} | {
        "source_split": F.col("source_split") == "train", "internal_split": F.col("internal_split").isin(INTERNAL_SPLITS),
        "assignment_unit": F.col("assignment_unit") == "item_component", "component_size": F.col("component_size") > 0,
    }


def paper_record_rules() -> dict[str, Column]:
    """Rules of one row of an internal paper manifest."""
    texts = ("paper_id", "internal_split", "item_id", "dataset", "prompt_group", "component_id", "strict_quota_id", "rule_version")
    return {f"text:{c}": is_text(c) for c in texts} | {
        "internal_split": F.col("internal_split").isin(INTERNAL_SPLITS), "inherited_id": ~F.col("paper_id").rlike(r"^paper_train_\d+$"), "paper_position": F.col("paper_position") >= 0,
    }


def leftover_record_rules() -> dict[str, Column]:
    return {f"text:{c}": is_text(c) for c in ("item_id", "dataset", "internal_split", "component_id", "reason")} | {"internal_split": F.col("internal_split").isin(INTERNAL_SPLITS)}


def calibration_package_rules(protocol_hash: str | None = None) -> dict[str, Column]:
    """Rules of a calibration package: where it comes from, and that its boundary, status and reason agree."""
    success, failure = F.col("calibration_status") == "success", F.col("calibration_status") == "failure"
    no_reason = F.trim(F.coalesce("calibration_failure_reason", F.lit(""))) == ""
    share = lambda c: F.col(c).between(0.0, 1.0) & ~F.isnan(c)
    rules = {f"text:{c}": is_text(c) for c in ("package_id", "checkpoint_id")} | {f"sha256:{c}": is_digest(c) for c in ("checkpoint_hash", *PROTOCOL_HASHES)}
    rules |= {"calibration_split": F.col("calibration_split") == "train_calibration", "no_gradient": F.col("calibration_no_gradient"), "no_replay": F.col("calibration_no_replay"), "no_ranking": F.col("calibration_no_checkpoint_ranking")}
    rules |= {"coverage": F.col("coverage").isNull() | share("coverage"), "status": success | failure, "boundary": F.when(success, share("stop_boundary")).otherwise(F.col("stop_boundary").isNull())}
    rules |= {"frozen": F.col("boundary_frozen") == success, "reason": F.when(success, no_reason).otherwise(~no_reason)}
    return rules | ({"protocol": F.col("quality_protocol_hash") == protocol_hash} if protocol_hash else {})


def policy_package_rules(protocol_hash: str | None = None, roles: list[str] | None = None) -> dict[str, Column]:
    """Rules of a policy package: only frozen boundaries of successful calibrations, never touched since."""
    rules = {f"text:{c}": is_text(c) for c in ("package_id", "checkpoint_id", "package_role")} | {f"sha256:{c}": is_digest(c) for c in ("checkpoint_hash", "calibration_package_hash", *PROTOCOL_HASHES)}
    rules |= {"status": F.col("calibration_status") == "success", "boundary": F.col("stop_boundary").between(0.0, 1.0) & ~F.isnan("stop_boundary"), "frozen": F.col("boundary_frozen"), "updates": F.col("dev_boundary_updates") == 0}
    rules |= {"role": F.col("package_role").isin(roles)} if roles else {}
    return rules | ({"protocol": F.col("quality_protocol_hash") == protocol_hash} if protocol_hash else {})


def record_faults(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(key columns, rule) of every rule that a row breaks."""
    return rows.select(*key, F.explode(failing(rules)).alias("rule"))


def _streamed_digests(members: DataFrame, groups: int) -> DataFrame:
    """(component_id, expected) of components of any size: ids are sorted and joined to blocks in ranges of (component, id), so that
    no task sorts a component; one SHA-256 a component then runs over its blocks in order, which come to its task one after the other."""

    def blocks(batches):
        order, last, ids = 0, None, []
        for batch in batches:
            for component, id_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (component != last or len(ids) >= BLOCK_IDS):
                    yield pa.RecordBatch.from_pydict({"component_id": [last], "k": [order], "text": ["\x1f".join(ids)]}, schema=kind)
                    order, ids = order + 1, []
                last = component
                ids.append(id_)
        if ids:
            yield pa.RecordBatch.from_pydict({"component_id": [last], "k": [order], "text": ["\x1f".join(ids)]}, schema=kind)

    def digests(batches):
        last, state = None, None
        for batch in batches:
            for component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or component != last:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"component_id": [last], "expected": [state.hexdigest()]})
                    last, state = component, hashlib.sha256(COMPONENT_VERSION.encode())
                state.update(b"\x1f" + text.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"component_id": [last], "expected": [state.hexdigest()]})

    kind = pa.schema([("component_id", pa.string()), ("k", pa.int64()), ("text", pa.string())])
    joined = members.repartitionByRange(groups, "component_id", "id").sortWithinPartitions("component_id", "id").mapInArrow(blocks, "component_id string, k long, text string")
    ranged = joined.withColumn("part", F.spark_partition_id())
    return ranged.repartition("component_id").sortWithinPartitions("component_id", "part", "k").select("component_id", "text").mapInArrow(digests, "component_id string, expected string")


def split_manifest_faults(rows: DataFrame, most: int | None = None, gathered: int = 1_000_000) -> DataFrame:
    """(kind, name, fault) of a split manifest as a whole: items that repeat, components whose declared size, digest, name or dataset do
    not fit their members, and components and prompt groups in more than one split.

    A component's digest is the SHA-256 of its version and all its sorted ids. It is recomputed inside an aggregation for components of
    up to ``gathered`` members. A larger one whose members declare several digests, and whose name is none that a digest gives, has both faults
    whatever its digest is; the others' ids are sorted by all tasks and run through one SHA-256 as a stream. A null id is in no digest.
    ``most``: components of more members are not recomputed but listed as ``unverified``.
    """
    items = rows.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("item").alias("kind"), F.col("item_id").alias("name"), F.lit("repeated").alias("fault"))
    summed = rows.groupBy("component_id").agg(
        F.count("*").alias("n"), F.min("component_size").alias("s0"), F.max("component_size").alias("s1"), F.min("stable_hash").alias("h0"), F.max("stable_hash").alias("h1"),
        F.min("dataset").alias("d0"), F.max("dataset").alias("d1"), F.min("internal_split").alias("p0"), F.max("internal_split").alias("p1"),
    )
    member = rows.select("component_id", F.col("item_id").cast("string").alias("id"))
    sized = summed if most is None else summed.where(F.col("n") <= most)
    undecided = F.col("h0").eqNullSafe(F.col("h1")) | F.col("component_id").rlike(f"^{COMPONENT_PREFIX}[0-9a-f]{{20}}$")
    large = sized.where(F.col("n") > gathered).select("component_id", "n", undecided.alias("open"))
    held = large.agg(F.count("*").alias("all"), F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("open")).first()
    small = member.join(sized.where(F.col("n") <= gathered).select("component_id"), "component_id", "left_semi") if held["all"] or most is not None else member
    digest = sha256(F.array_join(F.concat(F.array(F.lit(COMPONENT_VERSION)), "ids"), "\x1f"))
    expected = small.groupBy("component_id").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("component_id", digest.alias("expected"))
    if held["all"]:
        expected = expected.unionByName(large.where("NOT open").select("component_id", F.when(F.col("component_id") == f"{COMPONENT_PREFIX}-", "+").otherwise("-").alias("expected")))  # no digest is like that
    if held["open"]:
        whole = large.where("open").select("component_id")
        streamed = _streamed_digests(member.join(whole, "component_id", "left_semi").where("id IS NOT NULL"), max(8, min(2000, held["open"] // 200_000)))
        expected = expected.unionByName(whole.join(streamed, "component_id", "left").select("component_id", F.coalesce("expected", sha256(F.lit(COMPONENT_VERSION))).alias("expected")))
    checked = summed.join(expected, "component_id", "left")
    name = F.concat(F.lit(COMPONENT_PREFIX), F.substring("expected", 1, 20))
    rules = {
        "size": (F.col("s0") == F.col("n")) & (F.col("s1") == F.col("n")), "dataset": F.col("d0") == F.col("d1"), "unverified": F.col("expected").isNotNull() if most is not None else F.lit(True),
        "digest": F.col("expected").isNull() | (F.col("h0") == F.col("expected")) & (F.col("h1") == F.col("expected")), "name": F.col("expected").isNull() | (F.col("component_id") == name), "leak": F.col("p0") == F.col("p1"),
    }
    components = checked.select(F.lit("component").alias("kind"), F.col("component_id").alias("name"), F.explode(failing(rules)).alias("fault"))
    prompts = rows.groupBy("dataset", "prompt_group").agg(F.min("internal_split").alias("a"), F.max("internal_split").alias("b")).where("a <> b")
    return items.unionByName(components).unionByName(prompts.select(F.lit("prompt").alias("kind"), F.concat_ws("|", "dataset", "prompt_group").alias("name"), F.lit("leak").alias("fault")))
