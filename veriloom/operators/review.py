"""Review answers: the ones that stand, and what they say about each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FIELD_KEYS, WARNING_KEYS

QUESTION = ("job", "application_id", "key")


def latest_answers(log: DataFrame) -> DataFrame:
    """The last answer of each question by seq, unless that is an undo (clear). (WN1)

    max_by keeps one row a question on the map side, so a question that was answered very often costs no more.
    """
    kept = [F.struct(*[F.col(c) for c in log.columns if c not in QUESTION]).alias("r")]
    rows = log.withColumn("key", F.coalesce("key", F.lit(""))).select(*QUESTION, *kept)
    last = rows.groupBy(*QUESTION).agg(F.max_by("r", "r.seq").alias("r"))
    return last.where("r.decision <> 'clear'").select(*QUESTION, "r.*")


#: What an answer may be; clear takes one back.
DECISIONS = ("pass", "fail", "skip", "clear")


def checked_answers(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds error to answers (job, application_id, key, decision, seq): what is wrong with one, or null. labels: (job, application_id, prompts). (EV14)

    An answer is one of DECISIONS, to a label of the job, and to one of its questions; without a key (null or empty) it is to all of them.
    """
    known = labels.select("job", "application_id", F.transform("prompts", lambda p: p["key"]).alias("_keys"), F.lit(True).alias("_there"))
    rows = requests.withColumn("key", F.coalesce("key", F.lit(""))).join(known, ["job", "application_id"], "left")
    error = (
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), F.lit("decision must be one of " + ", ".join(DECISIONS)))
        .when(F.col("_there").isNull(), "no such label")
        .when((F.col("key") != "") & ~F.coalesce(F.array_contains("_keys", F.col("key")), F.lit(False)), F.concat(F.lit("this label has no question '"), "key", F.lit("'")))
    )
    return rows.withColumn("error", error).drop("_keys", "_there")


def answers_after(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """(job, application_id, seq, answers): each question's standing answer after each sound answer; an open one is null. (MP1)

    An answer without a key gives one to every question, on a label without questions to the label itself (key ''). Each question's last answer up to a seq is taken
    over that question alone, so a label that was answered very often is spread over its questions, never gathered.
    """
    sound = checked_answers(requests, labels).where("error is null").select("job", "application_id", "key", "decision", "seq")
    keys = F.transform("prompts", lambda p: p["key"])
    questions = labels.select("job", "application_id", F.explode(F.when(F.size(keys) > 0, F.array_distinct(keys)).otherwise(F.array(F.lit("")))).alias("question"))
    rows = sound.join(questions, ["job", "application_id"]).withColumn("_given", F.when((F.col("key") == "") | (F.col("key") == F.col("question")), F.col("decision")))
    upto = Window.partitionBy("job", "application_id", "question").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_now", F.nullif(F.last("_given", ignorenulls=True).over(upto), F.lit("clear")))
    return rows.groupBy("job", "application_id", "seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", "_now")))).alias("answers"))


def decision_records(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """One record for each sound answer, with what was concluded of its label: (seq, job, application_id, line), line being JSON without nulls' fields left out. (JS3, API3)

    labels may have source, index, image, overall, fields, warning, read_confidence, words_read, reader and timings; those that it lacks are null. The asked prompt is the
    question that was answered, without one the first.
    """
    sound = checked_answers(requests, labels).where("error is null").drop("error")
    own = ("source", "index", "image", "overall", "fields", "warning", "read_confidence", "words_read", "reader", "timings")
    rows = sound.join(labels.select("job", "application_id", "prompts", *[F.col(c) if c in labels.columns else F.lit(None).cast("string").alias(c) for c in own]), ["job", "application_id"])
    rows = rows.join(answers_after(requests, labels), ["job", "application_id", "seq"])
    prompts = F.transform("prompts", lambda p, i: p.withField("asked", F.when(F.col("key") != "", p["key"] == F.col("key")).otherwise(i == 0)))
    asked = F.coalesce(F.nullif(F.col("key"), F.lit("")), F.get("prompts", F.lit(0))["key"])
    ts = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx") if "ts" in requests.columns else F.lit(None).cast("string")
    record = F.struct(ts.alias("ts"), "job", *own[:2], "application_id", "image", "decision", "key", label_decision(F.col("answers")).alias("label_decision"), "overall", asked.alias("asked"), prompts.alias("prompts"), *own[4:])
    return rows.select("seq", "job", "application_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))


def label_decision(answers: Column) -> Column:
    """From a map of question to answer: '' without questions, fail if any fails, partial if any is open, pass if all pass, else skip. (MP2)"""
    given = F.map_values(answers)
    return (
        F.when(F.size(given) == 0, "").when(F.exists(given, lambda a: a == "fail"), "fail").when(F.exists(given, lambda a: a.isNull() | (a == "open")), "partial")
        .when(F.forall(given, lambda a: a == "pass"), "pass").otherwise("skip")
    )


def answers_text(answers: Column) -> Column:
    """key: answer; ... by key; an open question's answer is open. (MP3)"""
    return F.array_join(F.transform(F.array_sort(F.map_entries(answers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("open")))), "; ")


def asked_prompt(prompts: Column) -> Column:
    """The prompt marked as asked, else the first, else null. (JN12)"""
    return F.coalesce(F.get(F.filter(prompts, lambda p: p["asked"]), F.lit(0)), F.get(prompts, F.lit(0)))


def note_for(prompts: Column, fields: Column) -> Column:
    """The note of the field that the asked prompt is about, else its question. (JN10)"""
    p = asked_prompt(prompts)
    own = F.get(F.filter(fields, lambda f: f["key"] == p["key"]), F.lit(0))["note"]
    return F.coalesce(F.nullif(own, F.lit("")), p["question"], F.lit(""))


def question_order(key: Column) -> Column:
    """Fields, then warnings, then others by name; answers without a question last. (SO9)"""
    fixed = F.create_map(*[F.lit(x) for i, k in enumerate((*FIELD_KEYS, *WARNING_KEYS)) for x in (k, i)])
    return F.when(key == "(no question)", 99).otherwise(F.coalesce(fixed[key], F.lit(50)))


def question_summary(standing: DataFrame) -> DataFrame:
    """Per question: labels that raised it, times asked, answers and pass rate. standing: answers with prompts (array of key, asked). (AG4)"""
    raised = standing.select("job", "application_id", F.explode("prompts").alias("p")).select("job", "application_id", F.coalesce("p.key", F.lit("?")).alias("key")).distinct().groupBy("key").agg(F.count("*").alias("raised"))
    p = asked_prompt(F.col("prompts"))
    key = F.when(p.isNull(), "(no question)").otherwise(F.coalesce(p["key"], F.lit("?")))
    count = lambda a: F.count_if(F.col("decision") == a).alias(a)
    asked = standing.groupBy(key.alias("key")).agg(F.count("*").alias("asked"), count("pass"), count("fail"), count("skip"))
    both = raised.join(asked, "key", "full")
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("raised", "asked", "pass", "fail", "skip")}
    return both.withColumns(numbers).withColumn("pass_rate", F.try_divide(F.col("pass").cast("double"), F.col("pass") + F.col("fail")))


def top_notes(standing: DataFrame, decision: str, n: int = 10) -> DataFrame:
    """The most frequent (key, note) behind answers of one kind; the first seen of equals. (AG5)"""
    p = asked_prompt(F.col("prompts"))
    key = F.when(p.isNull(), "(no question)").otherwise(F.coalesce(p["key"], F.lit("?")))
    rows = standing.where(F.col("decision") == decision).select("seq", key.alias("key"), note_for(F.col("prompts"), F.col("fields")).alias("note"))
    return rows.groupBy("key", "note").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(n)


def calibration_rows(standing: DataFrame) -> DataFrame:
    """One row a label whose latest answer settled it: (job, application_id, decision, expect, notes). (AG6)"""
    p = asked_prompt(F.col("prompts"))
    confirmed = (F.col("decision") == "pass") & p["key"].isin(*FIELD_KEYS) & (p["verdict"] == "NEAR MATCH")
    one = F.struct("seq", F.when(confirmed, F.concat(p["key"], F.lit("=review"))).alias("expect"), F.concat(F.col("decision"), F.lit(": "), p["question"]).alias("note"))
    rows = standing.groupBy("job", "application_id").agg(F.max_by(F.coalesce("label_decision", "decision"), F.struct("ts", -F.col("seq"))).alias("decision"), F.array_sort(F.collect_list(one)).alias("all"))
    part = lambda c: F.filter(F.transform("all", lambda x: x[c]), lambda x: x.isNotNull())
    notes = F.coalesce(F.nullif(F.array_join(part("note"), " | "), F.lit("")), F.col("decision"))
    return rows.where(F.col("decision").isin("pass", "fail")).select("job", "application_id", "decision", F.array_join(F.array_distinct(part("expect")), ";").alias("expect"), notes.alias("notes"))


def prune_jobs(jobs: DataFrame, now: Column, keep: int = 50, hours: int = 24) -> DataFrame:
    """The newest jobs, at most `keep` and none older than `hours`. (WN4)"""
    young = jobs.where(F.col("created_at") >= now - F.expr(f"interval {hours} hours"))
    return young.orderBy(F.desc("created_at"), F.desc("job")).limit(keep)


def answer_maps(answers: DataFrame) -> DataFrame:
    """(job, application_id, answers): a map of question to answer, from standing answers. (MP1)"""
    return answers.groupBy("job", "application_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "decision")))).alias("answers"))


def status_counts(items: DataFrame) -> DataFrame:
    """Per job the number of items of each status, zeros kept, pending ones left out. (AG1)"""
    return items.groupBy("job").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "REVIEW", "FAIL", "ERROR")])


def job_progress(items: DataFrame) -> DataFrame:
    """Per job: items, processed, milliseconds a label and the time left, once ten are done; decided and cleared. (AG2, AG3)"""
    done = F.col("status") != "PENDING"
    rows = items.groupBy("job").agg(F.count("*").alias("total"), F.count_if(done).alias("processed"), F.bround(F.avg(F.when(done, F.col("total_ms"))), 3).alias("per_label_ms"), F.count_if(F.col("decision").isNotNull()).alias("decided"), F.count_if(F.col("decision") == "pass").alias("cleared"))
    return rows.withColumn("eta_ms", F.when(F.col("processed") >= 10, F.bround(F.col("per_label_ms") * (F.col("total") - F.col("processed")), 3)))


def triage(items: DataFrame) -> DataFrame:
    """Adds place: the order of review. Ranks come from counts of statuses, so nothing is sorted in one task. (SO1, SO2)"""
    from ..config import STATUS_RANK

    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.col("status")]
    within = F.row_number().over(Window.partitionBy("job", "_rank").orderBy("idx"))
    sizes = items.groupBy("job", rank.alias("_rank")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("job").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return items.withColumn("_rank", rank).withColumn("_n", within).join(before, ["job", "_rank"]).withColumn("place", F.col("before") + F.col("_n")).drop("_rank", "_n", "before")
