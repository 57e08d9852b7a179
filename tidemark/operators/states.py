"""State transitions as set operations: (current rows, commands) give the new rows and the rejected commands with their reasons.

Of several commands for one key in a batch the first by `seq` acts; the others are rejected as `superseded_in_batch` and can be sent again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_commands(commands: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return commands.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy(seq)))


def transition(current: DataFrame, commands: DataFrame, key: str, allowed: Column, changes: dict[str, Column], reason: Column) -> tuple[DataFrame, DataFrame]:
    """New rows and rejects (key, seq, reason). Conditions see the current columns and the command's as cmd_*; unknown keys are `missing`."""
    cmd = first_commands(commands, key)
    mine = cmd.select(*(F.col(c).alias(f"cmd_{c}") for c in commands.columns), "_turn")
    joined = current.join(mine.where("_turn = 1"), F.col(key) == F.col(f"cmd_{key}"), "left")
    acts = F.col(f"cmd_{key}").isNotNull() & F.coalesce(allowed, F.lit(False))
    new = joined.select(*(F.when(acts, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in current.columns))
    known = mine.join(current, F.col(key) == F.col(f"cmd_{key}"), "left")
    why = F.when(F.col(key).isNull(), "missing").when(F.col("_turn") > 1, "superseded_in_batch").when(~F.coalesce(allowed, F.lit(False)), reason)
    rejects = known.select(F.col(f"cmd_{key}").alias(key), F.col("cmd_seq").alias("seq"), why.alias("reason")).where("reason is not null")
    return new, rejects


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Current rows with changed ones replaced and new ones added: the last change of a key in order wins."""
    last = changes.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r").select(*current.columns)
    return current.join(last, key, "left_anti").unionByName(last)


def verify_uploads(uploads: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """upload_id, state, size, kind, verified_at: a known, not superseded upload of the reported size becomes verified, its first time kept; another size is
    `size_mismatch`. A null size is taken over for single puts only."""
    size = F.coalesce("size", F.when(F.col("kind") == "single_put", F.col("cmd_size")))
    ok = (F.col("state") != "superseded") & (size == F.col("cmd_size"))
    reason = F.when(F.col("state") == "superseded", "superseded").otherwise("size_mismatch")
    return transition(uploads, commands, "upload_id", ok, {"state": F.lit("verified"), "size": size, "verified_at": F.coalesce("verified_at", "cmd_at")}, reason)


def batch_states(batches: DataFrame, uploads: DataFrame) -> DataFrame:
    """Each batch with expected, actual, verified, failed and cleanup_pending counts, its manifest in order, and state: ready if and only if
    actual = verified = expected and no cleanup is pending."""
    per = uploads.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("actual"), F.count_if(F.col("state") == "verified").alias("verified"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if("cleanup_pending").alias("cleanup_pending"),
        F.transform(F.array_sort(F.collect_list(F.struct("upload_id", "state"))), lambda x: x["upload_id"]).alias("manifest"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = batches.join(per, "batch_id", "left").withColumns({c: zero(F.col(c)) for c in ("actual", "verified", "failed", "cleanup_pending")})
    state = F.when(F.col("failed") > 0, "failed").when((F.col("actual") == F.col("expected")) & (F.col("verified") == F.col("expected")) & (F.col("cleanup_pending") == 0), "ready").when(F.col("actual") == 0, "empty").otherwise("uploading")
    return out.withColumn("state", state)


def ready_or_rejected(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    ready = states.where("state = 'ready'").withColumn("state", F.lit("running"))
    return ready, states.where("state <> 'ready'").select("batch_id", F.concat(F.lit("batch_"), F.col("state")).alias("reason"))


def register_batches(batches: DataFrame, commands: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """batch_id, expected, kind: new batches are made, known ones grow; mixed kinds become `mixed`; more than `most` uploads are rejected."""
    asked = commands.groupBy("batch_id").agg(F.sum("add").alias("add"), F.count_distinct("kind").alias("kinds"), F.min("kind").alias("new_kind"))
    both = batches.join(asked, "batch_id", "full_outer")
    total = F.coalesce("expected", F.lit(0)) + F.coalesce("add", F.lit(0))
    good = total <= most
    kind = F.when(F.col("add").isNull(), F.col("kind")).when((F.col("kinds") > 1) | (F.col("kind") != F.col("new_kind")), "mixed").otherwise(F.col("new_kind"))
    new = both.where(good | F.col("expected").isNotNull()).select("batch_id", F.when(good, total).otherwise(F.col("expected")).cast("long").alias("expected"), F.when(good, kind).otherwise(F.col("kind")).alias("kind"))
    return new, both.where(~good).select("batch_id", F.lit("too_many_uploads").alias("reason"))


def multipart_plan(sessions: DataFrame, least_part: int = 5 << 20, most_parts: int = 10_000) -> DataFrame:
    """expected_parts and last_part_size of each session (upload_id, size, part_size), or why not."""
    n = F.ceil(F.col("size") / F.col("part_size"))
    out = sessions.withColumn("expected_parts", n).withColumn("last_part_size", F.col("size") - (n - 1) * F.col("part_size"))
    bad = F.when(F.col("part_size") < least_part, "part_too_small").when(F.col("expected_parts") > most_parts, "too_many_parts").when(F.col("size") <= 0, "empty_upload")
    return out.withColumn("reason", bad)


def record_parts(parts: DataFrame, arrivals: DataFrame) -> DataFrame:
    """upload_id, part, size: the last arrival of a part wins."""
    return upsert(parts, arrivals, ["upload_id", "part"], [F.desc("seq")])


def part_completeness(plan: DataFrame, parts: DataFrame) -> DataFrame:
    """Of each upload: parts and bytes received, and whether both are as expected."""
    got = parts.groupBy("upload_id").agg(F.count(F.lit(1)).alias("received_parts"), F.sum("size").alias("received_bytes"))
    out = plan.join(got, "upload_id", "left").withColumn("received_parts", F.coalesce("received_parts", F.lit(0))).withColumn("received_bytes", F.coalesce("received_bytes", F.lit(0)))
    return out.withColumn("complete", (F.col("received_parts") == F.col("expected_parts")) & (F.col("received_bytes") == F.col("size")))


def membership(batches: DataFrame, uploads: DataFrame) -> DataFrame:
    """batch_id, surplus: uploads beyond what was expected, never below 0; an upload counts once however often it is sent."""
    n = uploads.select("batch_id", "upload_id").distinct().groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return batches.join(n, "batch_id", "left").select("batch_id", F.greatest(F.coalesce("n", F.lit(0)) - F.col("expected"), F.lit(0)).alias("surplus"))


def expiries(rows: DataFrame, active: Column, at: str, expires: str, days: int = 7) -> DataFrame:
    return rows.withColumn(expires, F.when(F.col(expires).isNull() & active, F.col(at) + F.expr(f"interval {days} days")).otherwise(F.col(expires)))


def reedit_tasks(tasks: DataFrame, blocked: DataFrame) -> DataFrame:
    """One active task for each draft: those blocked without one get a pending task."""
    active = tasks.where(F.col("state").isin("pending", "running")).select("draft_id").distinct()
    fresh = blocked.select("draft_id", F.lit("pending").alias("state"), F.col("reason")).join(active, "draft_id", "left_anti").dropDuplicates(["draft_id"])
    return tasks.unionByName(fresh.select(*tasks.columns))


def reprocess(requests: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """pending requests become queued (a source is known), source_not_found, or exhausted after `most` attempts; each attempt counts."""
    known = sources.select("draft_id").distinct().withColumn("_known", F.lit(True))
    out = requests.join(known, "draft_id", "left")
    pending = F.col("state") == "pending"
    state = F.when(pending & (F.col("attempts") >= most), "exhausted").when(pending & F.coalesce("_known", F.lit(False)), "queued").when(pending, "source_not_found").otherwise(F.col("state"))
    attempts = F.when(pending & (F.col("attempts") < most), F.col("attempts") + 1).otherwise(F.col("attempts"))
    return out.withColumns({"attempts": attempts, "state": state}).drop("_known")


def stale(rows: DataFrame, by: list[str], at: str, as_of: Column, seconds: int = 900) -> DataFrame:
    """Of each key its latest time, the age in whole seconds at `as_of`, and whether that is over `seconds`."""
    out = rows.groupBy(*by).agg(F.max(at).alias("latest"))
    age = as_of.cast("long") - F.col("latest").cast("long")
    return out.withColumn("age", age).withColumn("stale", age > seconds)


def blocked_ids(failures: DataFrame, key: str, cap: int = 3) -> DataFrame:
    return failures.groupBy(key).agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= cap)


def terminal_status(runs: DataFrame) -> DataFrame:
    """status of a run from its exit and drafts: no_input, failed, no_reviewable_drafts or succeeded."""
    status = F.when(F.col("inputs") == 0, "no_input").when(F.col("exit_code") != 0, "failed").when(F.col("reviewable") == 0, "no_reviewable_drafts").otherwise("succeeded")
    return runs.withColumn("status", status)


def qa_applied(parts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Parts with qa_recorded, qa_passed and publishable, from the evidence of their path; without evidence not recorded, and not publishable."""
    out = parts.join(evidence.select("path", F.col("verdict").alias("_v"), F.col("critical").alias("_c")), "path", "left")
    passed = F.when(F.col("_v").isNotNull(), (F.col("_v") == "PASS") & (F.coalesce("_c", F.lit(0)) == 0))
    return out.withColumn("qa_recorded", F.col("_v").isNotNull()).withColumn("qa_passed", passed).withColumn("publishable", F.coalesce(passed, F.lit(False)) & (F.size("technical_issues") == 0)).drop("_v", "_c")


def touched(rows: DataFrame, changed: Column, as_of: Column, column: str = "updated_at") -> DataFrame:
    """Rows with the time of their last change."""
    return rows.withColumn(column, F.when(changed, as_of).otherwise(F.col(column)))


def manifest_upserts(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """athlete_key, parts, uploaded, revision: the latest revision of an athlete wins; `publishable` where all of its parts are uploaded."""
    merged = upsert(manifest, rows, ["athlete_key"], [F.desc("revision")])
    return merged.withColumn("publishable", (F.col("parts") > 0) & (F.col("uploaded") == F.col("parts")))


def only_active(batches: DataFrame, states: list[str], by: list[str]) -> DataFrame:
    """Of each group its batch in one of the states that no run has taken, where there is exactly one; else null, with `reason`: none_active or several_active.

    batches: batch_id, state, run_id, and the groups' columns.
    """
    free = F.when(F.col("state").isin(states) & F.col("run_id").isNull(), F.col("batch_id"))
    out = batches.groupBy(*by).agg(F.count(free).alias("active"), F.min(free).alias("one"))
    return out.select(*by, F.when(F.col("active") == 1, F.col("one")).alias("batch_id"), F.when(F.col("active") == 0, "none_active").when(F.col("active") > 1, "several_active").alias("reason"))


def begin_completion(uploads: DataFrame, commands: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads asked to complete become `completing` if they have a multipart session, are uploading, paused or completing, and all parts and bytes are there; what
    was asked and can't be is rejected with its reason. uploads: upload_id, state, size, protocol, session, expected_parts, completed_parts; parts: upload_id, size."""
    got = parts.groupBy(F.col("upload_id").alias("_u")).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_b"))
    there = uploads.join(got, F.col("upload_id") == F.col("_u"), "left").drop("_u").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_b": F.coalesce("_b", F.lit(0))})
    reason = (
        F.when((F.coalesce("protocol", F.lit("")) != "multipart") | F.col("session").isNull(), "no_multipart_session").when(~F.col("state").isin("uploading", "paused", "completing"), "wrong_state")
        .when(F.col("_n") != F.col("expected_parts"), "parts_missing").when(F.col("_b") != F.col("size"), "byte_total_differs")
    )
    new, rejects = transition(there, commands, "upload_id", reason.isNull(), {"state": F.lit("completing"), "completed_parts": F.col("_n").cast(uploads.schema["completed_parts"].dataType)}, reason)
    return new.drop("_n", "_b"), rejects


def recoverable_error(uploads: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A failed attempt is noted (2000 letters at most); completing goes back to uploading. Verified, superseded and aborted uploads are left alone."""
    ok = ~F.col("state").isin("verified", "superseded", "aborted")
    said = F.substring(F.coalesce("cmd_error", F.lit("multipart operation failed")), 1, 2000)
    return transition(uploads, commands, "upload_id", ok, {"state": F.when(F.col("state") == "completing", "uploading").otherwise(F.col("state")), "last_error": said}, F.col("state"))


def aborted(uploads: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads become aborted, their first time kept; verified and superseded ones stay."""
    ok = ~F.col("state").isin("verified", "superseded")
    said = F.nullif(F.substring(F.coalesce("cmd_error", F.lit("")), 1, 2000), F.lit(""))
    return transition(uploads, commands, "upload_id", ok, {"state": F.lit("aborted"), "aborted_at": F.coalesce("aborted_at", "cmd_at"), "last_error": said}, F.col("state"))


def local_cleanup(uploads: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is told of the local copy's cleanup (not_required, confirmed or failed), or why it can't be: confirmed only after verification, not_required only
    where none is, failed only with an error. uploads: upload_id, state, cleanup_required, cleanup, cleanup_error."""
    told = F.lower(F.trim(F.coalesce("cmd_status", F.lit(""))))
    reason = (
        F.when(~told.isin("not_required", "confirmed", "failed"), "unknown_status").when((told == "confirmed") & (F.col("state") != "verified"), "not_verified")
        .when((told == "not_required") & F.col("cleanup_required"), "cleanup_is_required").when((told == "failed") & (F.trim(F.coalesce("cmd_error", F.lit(""))) == ""), "error_missing")
    )
    error = F.when(told == "failed", F.substring("cmd_error", 1, 2000))
    return transition(uploads, commands, "upload_id", reason.isNull(), {"cleanup": told, "cleanup_error": error}, reason)
