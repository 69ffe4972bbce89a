"""The request's way from input to audit line, as DataFrame transforms.

Each step takes and returns the state frame (a row per request, key trace_id) and adds its name to
processing_steps. Nothing here calls a model: the answer is a template that a caller may replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.operators import audit, safety


def step(df: DataFrame, name: str, when: Column | None = None) -> DataFrame:
    more = F.array_append("processing_steps", F.lit(name))
    return df.withColumn("processing_steps", more if when is None else F.when(when, more).otherwise(F.col("processing_steps")))


def validate_input(df: DataFrame) -> DataFrame:
    """Adds valid: the question is neither null nor blank."""
    df = df.withColumn("processing_steps", F.array().cast("array<string>")).withColumn("valid", F.coalesce(F.trim("question") != "", F.lit(False)))
    return step(df, "validate_input")


def classify_request(df: DataFrame) -> DataFrame:
    """Adds the safety decision and route: invalid, clinical_question with a patient, protocol_question without."""
    df = safety.assess(df, "question").withColumnsRenamed({"decision": "safety_status"}).drop("reason")
    route = F.when(~F.col("valid"), "invalid").when(F.col("patient_id").isNotNull(), "clinical_question").otherwise("protocol_question")
    return step(df.withColumn("route", route), "classify_request")


def build_context(df: DataFrame, patients: DataFrame, protocols: DataFrame) -> DataFrame:
    """Joins what the two branches found: (patient_id, patient_context) and (trace_id, sources). An empty branch leaves nulls and says so."""
    df = df.join(patients, "patient_id", "left").join(protocols, "trace_id", "left")
    df = df.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    df = df.withColumn("fallback", F.when((F.size("sources") == 0) & F.col("patient_context").isNull(), "no_context").when(F.size("sources") == 0, "no_protocol").otherwise("none"))
    for name, when in (("retrieve_patient", F.col("patient_context").isNotNull()), ("retrieve_protocol", F.size("sources") > 0)):
        df = step(df, name, when)
    return step(df, "build_context")


def generate_answer(df: DataFrame, answer: Column | None = None) -> DataFrame:
    text = F.concat(F.lit("Sources: "), F.array_join("sources", ", ")) if answer is None else answer
    return step(df.withColumn("answer", F.when(F.col("valid") & (F.col("fallback") != "no_context"), text)), "generate_answer")


def validate_answer(df: DataFrame) -> DataFrame:
    """Adds requires_human_review: a risky or unassessed request, or no answer."""
    return step(df.withColumn("requires_human_review", ~F.coalesce(F.col("safety_status") == safety.ALLOW, F.lit(False)) | F.col("answer").isNull()), "validate_answer")


def human_review(df: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Requests for review get a verdict (trace_id, verdict) if there is one by now; the others pass."""
    if verdicts is None:
        df = df.withColumn("verdict", F.lit(None).cast("string"))
    else:
        df = df.join(verdicts.select("trace_id", "verdict"), "trace_id", "left")
    df = df.withColumn("verdict", F.when(F.col("requires_human_review"), F.coalesce("verdict", F.lit("pending"))).otherwise("not_needed"))
    return step(df, "human_review", F.col("requires_human_review"))


def format_response(df: DataFrame) -> DataFrame:
    shown = F.when(~F.col("requires_human_review") | (F.col("verdict") == "approved"), F.col("answer"))
    return step(df.withColumn("response", shown), "format_response")


def audit_log(df: DataFrame, event_time: str | None = None) -> DataFrame:
    """The audit events of the requests; no raw id is left."""
    return audit.audit_events(df.withColumn("human_review", F.col("requires_human_review")).drop("extra"), event_time)


def run(requests: DataFrame, patients: DataFrame, protocols: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """All steps up to the response."""
    df = classify_request(validate_input(requests))
    df = validate_answer(generate_answer(build_context(df, patients, protocols)))
    return format_response(human_review(df, verdicts))


def review_actions(asked: DataFrame, verdicts: DataFrame, remind: int, expire: int) -> DataFrame:
    """(trace_id, action, at, verdict, n): what reviews of (trace_id, asked_at) with verdicts (trace_id, given_at, verdict) come to.

    ``remind`` and ``expire`` are microseconds after the request. Actions: ask; remind if there is no verdict by then; resume with the first verdict
    in time (ties: the least), else expire; every other verdict is repeated (behind a resume), late, or unknown (no request before it).
    ``n`` counts rows that are alike. Of repeated requests the earliest counts; null ids and times are left out.
    """
    later = lambda c, us: F.timestamp_micros(F.unix_micros(c) + us)
    first = asked.filter("trace_id is not null and asked_at is not null").groupBy("trace_id").agg(F.min(F.col("asked_at").cast("timestamp")).alias("asked"))
    given = verdicts.filter("trace_id is not null and given_at is not null").groupBy("trace_id", F.col("given_at").cast("timestamp").alias("at"), "verdict").agg(F.count("*").alias("n"))
    given = given.join(first, "trace_id", "left").withColumn("known", F.coalesce(F.col("at") >= F.col("asked"), F.lit(False)))
    in_time = F.col("known") & (F.col("at") <= later(F.col("asked"), expire))
    taken = given.filter(in_time).groupBy("trace_id").agg(F.min(F.struct("at", F.coalesce("verdict", F.lit("")).alias("least"), "verdict")).alias("t"))
    state = first.join(taken, "trace_id", "left")
    step = lambda name, at, when=F.lit(True), verdict=F.lit(None).cast("string"): F.when(when, F.struct(F.lit(name).alias("action"), at.alias("at"), verdict.alias("verdict"), F.lit(1).cast("long").alias("n")))
    reminded, expired = later(F.col("asked"), remind), later(F.col("asked"), expire)
    steps = F.array(step("ask", F.col("asked")), step("remind", reminded, F.col("t").isNull() | (F.col("t.at") > reminded)), step("expire", expired, F.col("t").isNull()), step("resume", F.col("t.at"), F.col("t").isNotNull(), F.col("t.verdict")))
    own = state.select("trace_id", F.inline(F.filter(steps, lambda s: s.isNotNull())))
    is_taken = F.col("t").isNotNull() & (F.col("at") == F.col("t.at")) & F.col("verdict").eqNullSafe(F.col("t.verdict"))
    rest = given.join(taken, "trace_id", "left").withColumn("n", F.col("n") - is_taken.cast("int")).filter("n > 0")
    action = F.when(~F.col("known"), "unknown").when(F.col("t").isNotNull(), "repeated").otherwise("late")
    return own.unionByName(rest.select("trace_id", action.alias("action"), "at", "verdict", "n"))
