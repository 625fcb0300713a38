"""The star-schema tables as applications, labels, answers and pages, with defects planted by a rule of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import general_number
from ..sources.shared import dealt

SIZES = (50, 375, 750, 1000, 1750)
COUNTRIES = ("Albania", "Brazil", "Canada", "Denmark", "Estonia", "Finland", "Greece")
DEFECTS = ("none", "abv", "volume", "case", "letter", "no_alcohol", "proof", "lost_point")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _volume(ml):
    return F.when(ml >= 1000, F.concat(general_number(ml / 1000.0), F.lit(" L"))).otherwise(F.concat(ml.cast("string"), F.lit(" mL")))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as applications: the name is the brand, the type the class, the size the alcohol content in percent."""
    key, abv = F.col("p_partkey"), F.col("p_size")
    ml = F.element_at(F.array(*[F.lit(s) for s in SIZES]), (key % 5 + 1).cast("int"))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey").select(
        key.alias("label_id"), F.col("p_name").alias("brand_name"), F.col("p_type").alias("class_type"), F.concat(abv.cast("string"), F.lit("% Alc./Vol. ("), (2 * abv).cast("string"), F.lit(" Proof)")).alias("alcohol_content"),
        _volume(ml).alias("net_contents"), F.concat(F.lit("Product of "), F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (key % 7 + 1).cast("int"))).alias("country_of_origin"), abv.alias("abv"), ml.alias("ml"), F.element_at(F.array(*[F.lit(d) for d in DEFECTS]), (key % 8 + 1).cast("int")).alias("defect"),
    )


def label_lines(apps: DataFrame) -> DataFrame:
    """What the labels of applications say, line by line, with the planted defects."""
    is_ = lambda d: F.col("defect") == d
    brand = F.when(is_("case"), F.upper("brand_name")).when(is_("letter"), F.concat(F.lit("z"), F.substring("brand_name", 2, 99))).otherwise(F.col("brand_name"))
    abv = F.when(is_("abv"), F.col("abv") + 5).otherwise(F.col("abv"))
    proof = F.when(is_("proof"), 2 * F.col("abv") + 10).otherwise(2 * abv)
    alcohol = F.when(is_("no_alcohol"), F.lit("bottled with care")).otherwise(F.concat(F.lit("ALC. "), abv.cast("string"), F.lit("% BY VOL. ("), proof.cast("string"), F.lit(" PROOF)")))
    volume = F.when(is_("volume"), _volume(F.element_at(F.array(*[F.lit(s) for s in SIZES]), ((F.col("label_id") + 1) % 5 + 1).cast("int")))).when(is_("lost_point"), F.replace("net_contents", F.lit("."), F.lit(""))).otherwise(F.col("net_contents"))
    lines = F.array(brand, F.col("class_type"), alcohol, F.concat(F.lit("NET "), volume), F.col("country_of_origin"))
    return apps.select("label_id", F.posexplode(lines).alias("line_no", "text"))


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of review answers: jobs of ten users, questions by props.k, undone by errors."""
    k = F.get_json_object("props", "$.k").cast("int")
    keys = F.array(*[F.lit(x) for x in ("brand_name", "class_type", "alcohol_content", "net_contents", "warning_wording")])
    decision = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "click", "fail").when(F.col("event_type") == "view", "skip").when(F.col("event_type") == "error", "clear").otherwise("pass")
    key = F.element_at(keys, (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("job"), F.col("user_id").alias("application_id"), key.alias("key"), decision.alias("decision"), F.col("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("total_ms"))


def with_prompts(answers: DataFrame) -> DataFrame:
    """Adds prompts (the question asked, and one more) and fields, as a log record has them."""
    asked = F.struct(F.col("key").alias("key"), F.lit("NEAR MATCH").alias("verdict"), F.concat(F.lit("is "), F.col("key"), F.lit(" right?")).alias("question"), F.lit(True).alias("asked"))
    other = F.struct(F.lit("net_contents").alias("key"), F.lit("MISMATCH").alias("verdict"), F.lit("is net_contents right?").alias("question"), F.lit(False).alias("asked"))
    fields = F.array(F.struct(F.lit("brand_name").alias("key"), F.concat(F.lit("note "), (F.col("seq") % 3).cast("string")).alias("note")))
    return answers.withColumns({"prompts": F.array(other, asked), "fields": fields, "label_decision": F.lit(None).cast("string")})


#: The same projections for DuckDB.
APPS_SQL = """
    apps AS (
        SELECT p_partkey AS label_id, p_name AS brand_name, p_type AS class_type, p_size AS abv, [50, 375, 750, 1000, 1750][p_partkey % 5 + 1] AS ml,
            ['50 mL', '375 mL', '750 mL', '1 L', '1.75 L'][p_partkey % 5 + 1] AS net_contents, ['50 mL', '375 mL', '750 mL', '1 L', '1.75 L'][(p_partkey + 1) % 5 + 1] AS other_net,
            p_size || '% Alc./Vol. (' || 2 * p_size || ' Proof)' AS alcohol_content, 'Product of ' || ['Albania', 'Brazil', 'Canada', 'Denmark', 'Estonia', 'Finland', 'Greece'][p_partkey % 7 + 1] AS country_of_origin,
            ['none', 'abv', 'volume', 'case', 'letter', 'no_alcohol', 'proof', 'lost_point'][p_partkey % 8 + 1] AS defect
        FROM part
    )"""
ANSWERS_SQL = """
    answers AS (
        SELECT user_id % 10 AS job, user_id AS application_id, ['brand_name', 'class_type', 'alcohol_content', 'net_contents', 'warning_wording'][CAST(json_extract(props, '$.k') AS int) % 5 + 1] AS key,
            CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'click' THEN 'fail' WHEN 'view' THEN 'skip' WHEN 'error' THEN 'clear' ELSE 'pass' END AS decision, ts, event_id AS seq, value AS total_ms
        FROM events
    ), standing AS (
        SELECT * FROM (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY job, application_id, key ORDER BY seq DESC) = 1) WHERE decision <> 'clear'
    )"""
