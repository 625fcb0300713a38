"""Registered queries of the document-verification operators, each over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import figures, similarity
from .functions import text as tx
from .config import MANDATED
from .operators import batch, evidence, geometry, lines, matching, pairs, passage, review, scoring, statement
from .plans import verify as plans
from .plans.projections import ANSWERS_SQL, APPS_SQL, answer_log, applications, label_lines, table, with_prompts
from .sources import readers, sinks
from .sources.shared import dealt, shared_folder, shuffled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# The flagship


@query(f"""
    WITH {APPS_SQL}, v AS (
        SELECT *, CASE defect WHEN 'abv' THEN 'FAIL' WHEN 'volume' THEN 'FAIL' WHEN 'case' THEN 'REVIEW' WHEN 'letter' THEN 'REVIEW' WHEN 'no_alcohol' THEN 'FAIL' WHEN 'proof' THEN 'FAIL'
            WHEN 'lost_point' THEN CASE WHEN net_contents LIKE '%.%' THEN 'REVIEW' ELSE 'PASS' END ELSE 'PASS' END AS overall FROM apps
    ) SELECT defect, overall, count(*) AS labels FROM v GROUP BY ALL""")
def verify_labels(spark, sf):
    """All fields of all applications against their labels, rolled up to a status. (API1, EV5)"""
    apps = applications(spark, sf)
    found = plans.verify(apps, label_lines(apps))
    return apps.select("label_id", "defect").join(shuffled(found), "label_id").groupBy("defect", "overall").agg(F.count("*").alias("labels"))


# Text


LOOSE_SQL = r"""
    words AS (
        SELECT doc_id, lower(strip_accents(replace(text, '…', '...'))) AS t FROM documents
    ), abv AS (
        SELECT doc_id, replace(regexp_replace(t, '(?i)alcohol\s+by\s+volume|alc(?:ohol)?\.?\s*/\s*vol(?:ume)?\.?|alc(?:ohol)?\.?\s+by\s+vol(?:ume)?\.?|alc\.?\s*vol\.?|\babv\b|\bby\s+vol(?:ume)?\.?|\balc\.?(\s|$)', ' abv \1', 'g'), '_', ' ') AS t FROM words
    ), chars AS (
        SELECT doc_id, string_split(' ' || t || ' ', '') AS c FROM abv
    ), bare AS (
        SELECT doc_id, array_to_string(list_transform(range(2, len(c)), lambda i: CASE
            WHEN regexp_matches(c[i], '[\p{L}\p{N}\p{M}\s%]') THEN c[i]
            WHEN NOT regexp_matches(c[i - 1], '[0-9]') THEN ' '
            WHEN regexp_matches(c[i + 1], '[0-9]') THEN c[i]
            WHEN c[i] IN ('.', ',') THEN c[i]
            ELSE ' ' END), '') AS t FROM chars
    ), loose AS (SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS loose FROM bare)"""


@query(rf"WITH {LOOSE_SQL} SELECT doc_id, sha256(loose) AS loose FROM loose")
def normalize_loose(spark, sf):
    """(SF1-SF6)"""
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize_loose("text"), 256).alias("loose"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '\s*[®©™℠]', '', 'g'), '\s+', ' ', 'g'))) AS strict FROM documents")
def normalize_strict(spark, sf):
    """(SF4)"""
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.normalize_strict("text"), 256).alias("strict"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(len(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' '))) AS BIGINT) AS n_words FROM l WHERE trim(t, ' ') <> '' GROUP BY doc_id""")
def word_tokens_lines(spark, sf):
    """(AR2)"""
    rows = lines.line_words(lines.document_lines(table(spark, sf, "documents")))
    return rows.groupBy(F.col("label_id").alias("doc_id")).agg(F.count_distinct("line_no").alias("n_lines"), F.count("*").alias("n_words"))


@query(r"""
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
    SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS text, round_even(avg(i % 100), 3) AS conf FROM w WHERE i % 7 <> 0 GROUP BY doc_id""")
def group_words(spark, sf):
    """Words with confidences back to lines. (AG19)"""
    w = table(spark, sf, "documents").select(F.col("doc_id").alias("label_id"), F.lit(0).alias("line_no"), F.posexplode(F.split("text", " ")).alias("p", "text"))
    w = w.withColumn("word_no", F.col("p") + 1).withColumn("conf", F.when(F.col("word_no") % 7 == 0, -1.0).otherwise((F.col("word_no") % 100).cast("double")))
    return lines.group_words(w).select(F.col("label_id").alias("doc_id"), F.sha2("text", 256).alias("text"), "conf")


@query("SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(p_name || ' no 15', ' ', ''), 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), '0', 'o'), '1', 'l'), '|', 'l'), 'i', 'l'), '5', 's'), '8', 'b') AS folded FROM part")
def shape_fold(spark, sf):
    """(SF11)"""
    return table(spark, sf, "part").select("p_partkey", tx.shape_fold(F.concat("p_name", F.lit(" No. 15"))).alias("folded"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_brand || '  (' || p_name || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'LBL-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS name FROM part")
def names_and_numbers(spark, sf):
    """(SF20, SNK3, SNK10)"""
    return table(spark, sf, "part").select("p_partkey", tx.slug(F.concat("p_brand", F.lit("  ("), "p_name", F.lit(")"))).alias("slug"), sinks.numbered("LBL", F.col("p_partkey")).alias("name"))


@query("SELECT n_nationkey, ['saint lucia', 'netherlands', 'sainte marie', 'cote divoire'][n_nationkey % 4 + 1] AS key FROM nation")
def country_keys(spark, sf):
    """(SF16)"""
    name = F.element_at(F.array(*[F.lit(x) for x in ("St. Lucia", "The Netherlands", "STE MARIE", "Côte dIvoire")]), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf, "nation").select("n_nationkey", tx.country_key(name).alias("key"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '45' WHEN 1 THEN '13.5' WHEN 2 THEN '0.25' WHEN 3 THEN '1000' ELSE '7.125' END AS shown FROM documents")
def general_numbers(spark, sf):
    """(SF24)"""
    value = F.element_at(F.array(*[F.lit(x) for x in (45.0, 13.5, 0.25, 1000.0, 7.125)]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", tx.general_number(value).alias("shown"))


# Similarity

LCS_SQL = """list_extract(list_reduce(list_prepend([0 for _ in range(len(b) + 1)], list_transform(string_split(a, ''), lambda ch: [ord(ch)])),
    lambda prev, ch: list_reduce(list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: [j])),
        lambda row, j: list_append(row, CASE WHEN ord(substr(b, j[1], 1)) = ch[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], row[-1]) END))), -1)"""


@query(f"""
    WITH n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT l.x AS a, r.x AS b FROM n l JOIN n r ON l.x < r.x)
    SELECT a, b, CAST(round_even(200.0 * {LCS_SQL} / (length(a) + length(b)), 0) AS INTEGER) AS ratio FROM p""")
def fuzzy_ratio_names(spark, sf):
    """(FZ1, JN5)"""
    n = table(spark, sf, "part").select("p_name").distinct()
    every = n.select(F.col("p_name").alias("a")).join(n.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))
    return every.select("a", "b", similarity.ratio("a", "b").alias("ratio"))


@query("""
    WITH n AS (SELECT DISTINCT p_name AS x FROM part)
    SELECT l.x AS a, r.x AS b, CAST(levenshtein(l.x, r.x) AS INTEGER) AS distance FROM n l JOIN n r ON l.x < r.x WHERE levenshtein(l.x, r.x) <= 4""")
def levenshtein_names(spark, sf):
    """(FZ4)"""
    return pairs.within_edits(table(spark, sf, "part").select(F.col("p_name").alias("text")), 4)


@query("""
    WITH n AS (SELECT DISTINCT p_name AS x FROM part), s AS (SELECT x, split_part(x, ' ', 2) || ' ' || split_part(x, ' ', 1) AS y FROM n)
    SELECT x AS a, y AS b, 100 AS ratio FROM s""")
def token_sort_names(spark, sf):
    """(FZ2)"""
    n = table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    swapped = n.withColumn("b", F.concat_ws(" ", F.split_part("a", F.lit(" "), F.lit(2)), F.split_part("a", F.lit(" "), F.lit(1))))
    return swapped.select("a", "b", similarity.token_sort_ratio("a", "b").alias("ratio"))


@query("SELECT count(*) AS pairs, count(*) AS at_hundred FROM (SELECT DISTINCT p_name FROM part)")
def partial_ratio_names(spark, sf):
    """(FZ3)"""
    n = table(spark, sf, "part").select("p_name").distinct().withColumn("long", F.concat(F.lit("made by "), F.col("p_name"), F.lit(" co")))
    return n.withColumn("r", similarity.best_part_ratio("p_name", "long")).agg(F.count("*").alias("pairs"), F.count_if(F.col("r") == 100).alias("at_hundred"))


@query("""
    WITH n AS (SELECT DISTINCT p_size + 100 AS x FROM part)
    SELECT l.x AS a, r.x AS b FROM n l JOIN n r ON l.x < r.x WHERE CAST(l.x // 100 <> r.x // 100 AS INT) + CAST(l.x // 10 % 10 <> r.x // 10 % 10 AS INT) + CAST(l.x % 10 <> r.x % 10 AS INT) = 1""")
def one_digit_apart(spark, sf):
    """(FZ7)"""
    return pairs.one_digit_apart(table(spark, sf, "part").select((F.col("p_size") + 100).alias("value")))


# Figures


@query(f"""WITH {APPS_SQL} SELECT label_id, CAST(abv AS DOUBLE) AS abv, CAST(2 * abv AS DOUBLE) AS proof, abv || '% Alc./Vol. (' || 2 * abv || ' Proof)' AS shown FROM apps""")
def parse_alcohol_figures(spark, sf):
    """(PR1, PR2, MA1)"""
    rows = applications(spark, sf).select("label_id", figures.alcohol_value("alcohol_content").alias("v"))
    return rows.select("label_id", "v.abv", "v.proof", F.col("v.text").alias("shown"))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(round(l_quantity * [1.0, 10.0, 1000.0, 29.5735, 473.176][CAST(l_quantity AS INT) % 5 + 1], 2) AS DOUBLE) AS ml, ['mL', 'cL', 'L', 'fl oz', 'pt'][CAST(l_quantity AS INT) % 5 + 1] AS unit
    FROM lineitem""")
def parse_volume_figures(spark, sf):
    """(PR3-PR6, MA2)"""
    q = F.col("l_quantity").cast("int")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("ml", "cl", "Litres", "FL. OZ.", "PINTS")]), q % 5 + 1)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", figures.volume_value(F.concat(q.cast("string"), F.lit(" "), unit)).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "v.ml", "v.unit")


def _figures(spark, sf, key):
    apps = applications(spark, sf)
    rows = plans.figure_results(apps, label_lines(apps)).where(F.col("key") == key)
    return rows.select("label_id", "result.verdict", "result.score", "result.code")


@query(f"""
    WITH {APPS_SQL} SELECT label_id, CASE defect WHEN 'abv' THEN 'MISMATCH' WHEN 'no_alcohol' THEN 'NOT FOUND' WHEN 'proof' THEN 'MISMATCH' ELSE 'MATCH' END AS verdict,
        CASE WHEN defect IN ('abv', 'no_alcohol', 'proof') THEN 0 ELSE 100 END AS score,
        CASE defect WHEN 'abv' THEN 'differs' WHEN 'no_alcohol' THEN 'no_figure' WHEN 'proof' THEN 'proof_differs' ELSE 'same' END AS code FROM apps""")
def compare_alcohol_verdict(spark, sf):
    """(MT7)"""
    return _figures(spark, sf, "alcohol_content")


@query(f"""
    WITH {APPS_SQL} SELECT label_id, CASE WHEN defect = 'volume' THEN 'MISMATCH' WHEN defect = 'lost_point' AND net_contents LIKE '%.%' THEN 'NEAR MATCH' ELSE 'MATCH' END AS verdict,
        CASE WHEN defect = 'volume' THEN 0 WHEN defect = 'lost_point' AND net_contents LIKE '%.%' THEN 90 ELSE 100 END AS score,
        CASE WHEN defect = 'volume' THEN 'differs' WHEN defect = 'lost_point' AND net_contents LIKE '%.%' THEN 'lost_point' ELSE 'same' END AS code FROM apps""")
def compare_volume_verdict(spark, sf):
    """(MT8)"""
    return _figures(spark, sf, "net_contents")


@query(f"""
    WITH {APPS_SQL} SELECT label_id, CASE WHEN defect IN ('case', 'letter') THEN 'NEAR MATCH' ELSE 'MATCH' END AS verdict,
        CASE defect WHEN 'case' THEN 'case_differs' WHEN 'letter' THEN CASE WHEN length(brand_name) * 12 < 100 AND 200.0 * (length(brand_name) - 1) / (2 * length(brand_name)) < 87.5 THEN 'one_letter' ELSE 'similar' END ELSE 'exact' END AS code FROM apps""")
def compare_text_verdict(spark, sf):
    """Brands located on labels and classified. (MT1, MT3, MT6)"""
    apps = applications(spark, sf)
    rows = matching.compare_located(plans.text_values(apps.select("label_id", "brand_name")), label_lines(apps))
    return rows.select("label_id", "result.verdict", "result.code")


@query(f"WITH {APPS_SQL} SELECT label_id, country_of_origin AS text, 100 AS score, 4 AS line_start, 4 AS line_end FROM apps")
def locate_values(spark, sf):
    """(MT1, WN3)"""
    apps = applications(spark, sf)
    values = apps.select("label_id", F.lit("country_of_origin").alias("key"), F.col("country_of_origin").alias("expected"))
    return matching.locate(values, label_lines(apps)).select("label_id", "text", "score", "line_start", "line_end")


@query(f"WITH {APPS_SQL} SELECT label_id, brand_name AS text, 100 AS score FROM apps WHERE length(replace(brand_name, ' ', '')) >= 4")
def locate_letter_spaced(spark, sf):
    """(MT2, SF13)"""
    apps = applications(spark, sf)
    spaced = apps.select("label_id", F.lit(0).alias("line_no"), F.array_join(F.split(F.replace("brand_name", F.lit(" "), F.lit("")), ""), " ").alias("text"))
    values = apps.select("label_id", F.lit("brand_name").alias("key"), F.col("brand_name").alias("expected"))
    found = matching.locate_letter_spaced(values, spaced).join(shuffled(apps.select("label_id", "brand_name")), "label_id")
    return found.where(F.replace("text", F.lit(" "), F.lit("")) == F.replace("brand_name", F.lit(" "), F.lit(""))).select("label_id", F.col("brand_name").alias("text"), "score")


@query("""
    SELECT n_nationkey AS label_id, CASE n_nationkey % 5 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'NEAR MATCH' WHEN 3 THEN 'MATCH' ELSE 'NOT FOUND' END AS verdict,
        CASE n_nationkey % 5 WHEN 0 THEN 'stated' WHEN 1 THEN 'other_country' WHEN 2 THEN 'several_countries' WHEN 3 THEN 'on_its_own_line' ELSE 'no_statement' END AS code FROM nation""")
def compare_country_verdict(spark, sf):
    """(MT11, PR7, SF16)"""
    names = F.array(*[F.lit(x) for x in ("Albania", "Brazil", "Canada", "St. Lucia", "Denmark")])
    key = F.col("n_nationkey")
    n = table(spark, sf, "nation").select(key.alias("label_id"), F.element_at(names, key % 5 + 1).alias("country"))
    said = F.element_at(F.array(F.array(F.concat(F.lit("Product of "), F.col("country"))), F.array(F.lit("Imported from Zimbabwe by X")), F.array(F.concat(F.lit("PRODUCT OF "), F.upper("country")), F.lit("Made in Peru, 2020")), F.array(F.lit("Saint Lucia")), F.array(F.lit("Bottled in Bond"), F.lit("nothing here"))), (key % 5 + 1).cast("int"))
    lines_ = table(spark, sf, "nation").withColumn("country", F.element_at(names, key % 5 + 1)).select(key.alias("label_id"), F.posexplode(said).alias("line_no", "text"))
    return matching.compare_country(n.select("label_id", F.concat(F.lit("Product of "), F.col("country")).alias("expected")), lines_).select("label_id", "result.verdict", "result.code")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 2 ELSE 1 END AS n FROM lineitem")
def superseded_readings(spark, sf):
    """A closer reading corrects the page's by one digit, where it is close enough. (MT9)"""
    q = F.col("l_quantity").cast("int")
    volume = lambda x: F.struct(x.cast("double").alias("ml"), F.lit("mL").alias("unit"), F.concat(x.cast("string"), F.lit(" mL")).alias("text"), x.cast("string").alias("digits"))
    page = F.array(volume(F.lit(750)), F.when(q > 30, volume(F.lit(12))).otherwise(volume(F.lit(790))))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", page.alias("page"), F.array(volume(F.lit(750))).alias("closer"))
    same = lambda c: F.abs(c["ml"] - 750) <= 0.5
    return rows.select("l_orderkey", "l_linenumber", F.size(matching.superseded(F.col("page"), F.col("closer"), same, lambda c: F.lit(False), lambda c: c["digits"])).alias("n"))


# Geometry

BOXES_SQL = "boxes AS (SELECT l_orderkey AS label_id, l_linenumber AS line_no, CAST(l_quantity AS INT) * 10 AS \"left\", CAST(l_partkey % 40 AS INT) * 5 AS top, CAST(l_suppkey % 20 AS INT) * 10 + 20 AS width, 30 AS height FROM lineitem)"


def _boxes(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("label_id"), F.col("l_linenumber").alias("line_no"), (F.col("l_quantity").cast("int") * 10).alias("left"), ((F.col("l_partkey") % 40).cast("int") * 5).alias("top"), ((F.col("l_suppkey") % 20).cast("int") * 10 + 20).alias("width"), F.lit(30).alias("height"))


@query(f"""WITH {BOXES_SQL} SELECT label_id, line_no, min("left") AS "left", min(top) AS top, max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height FROM boxes GROUP BY label_id, line_no""")
def line_boxes(spark, sf):
    """(AG14)"""
    return geometry.line_boxes(_boxes(spark, sf))


@query(f"""
    WITH {BOXES_SQL}, p AS (
        SELECT a.label_id, a.line_no AS a, b.line_no AS b, greatest(0, least(a."left" + a.width, b."left" + b.width) - greatest(a."left", b."left")) * greatest(0, least(a.top + a.height, b.top + b.height) - greatest(a.top, b.top))
            / CAST(least(a.width * a.height, b.width * b.height) AS DOUBLE) AS share FROM boxes a JOIN boxes b ON a.label_id = b.label_id AND a.line_no < b.line_no
    ) SELECT label_id, a, b, round(share, 9) AS share FROM p WHERE share >= 0.5""")
def same_place_pairs(spark, sf):
    """(JN6, JN7, MA3)"""
    return geometry.same_place_pairs(_boxes(spark, sf), 0.5).withColumn("share", F.round("share", 9))


@query(f"""WITH {BOXES_SQL} SELECT label_id, arg_max(line_no, struct_pack(h := h, l := -line_no)) AS line FROM (SELECT label_id, line_no, median(width) AS h FROM boxes GROUP BY ALL) GROUP BY label_id""")
def prominent_line(spark, sf):
    """(AG13, WN2)"""
    words = _boxes(spark, sf).select("label_id", "line_no", F.lit("word").alias("text"), F.col("width").alias("height"))
    return geometry.prominent_line(geometry.line_heights(words))


@query(f"""WITH {BOXES_SQL} SELECT label_id, line_no, round_even(100.0 * "left" / 1000, 2) AS x, round_even(100.0 * top / 777, 2) AS y FROM boxes""")
def percent_boxes(spark, sf):
    """(AG15)"""
    b = F.struct("left", "top", "width", "height")
    box = geometry.percent_box(b, F.lit(1000), F.lit(777))
    return _boxes(spark, sf).select("label_id", "line_no", box[0].alias("x"), box[1].alias("y"))


@query(f"""
    WITH {BOXES_SQL} SELECT label_id, line_no, CASE line_no % 3 WHEN 0 THEN "left" WHEN 1 THEN top ELSE 1000 - top - height END AS "left", CASE line_no % 3 WHEN 0 THEN top WHEN 1 THEN 800 - "left" - width ELSE "left" END AS top,
        CASE line_no % 3 WHEN 0 THEN width ELSE height END AS width FROM boxes""")
def upright_boxes(spark, sf):
    """(MA4)"""
    turn = F.element_at(F.array(F.lit(0), F.lit(90), F.lit(270)), F.col("line_no") % 3 + 1)
    box = geometry.upright(F.struct("left", "top", "width", "height"), turn, F.lit(1000), F.lit(800), F.lit(1.0), F.lit(0), F.lit(0))
    return _boxes(spark, sf).select("label_id", "line_no", box.alias("b")).select("label_id", "line_no", "b.left", "b.top", "b.width")


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line_no FROM l),
    w AS (SELECT doc_id, line_no, t, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) - 1 AS i FROM x WHERE trim(t, ' ') <> ''),
    p AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
    SELECT doc_id AS label_id, count(*) AS words, CAST(sum(CAST(10 + round_even(1000 * before / length(t), 0) AS INT)) AS BIGINT) AS "left" FROM p WHERE w <> '' GROUP BY doc_id""")
def word_boxes_from_lines(spark, sf):
    """(IM10)"""
    rows = lines.document_lines(table(spark, sf, "documents")).withColumns({"left": F.lit(10), "top": F.lit(0), "width": F.lit(1000), "height": F.lit(20)})
    return geometry.words_of_lines(rows).groupBy("label_id").agg(F.count("*").alias("words"), F.sum("left").alias("left"))


@query("""
    WITH px AS (SELECT label, CAST(least(255, greatest(0, floor((unnest(embedding) + 1) * 128))) AS INT) AS level FROM embeddings), c AS (SELECT label, level, count(*) AS n FROM px GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER a AS an, sum(n * level) OVER a AS s, sum(n) OVER u AS n0, sum(n * level) OVER u AS s0 FROM c WINDOW a AS (PARTITION BY label), u AS (PARTITION BY label ORDER BY level)),
    v AS (SELECT label, level, round(n0 * (an - n0) * (s0 / n0 - (s - s0) / (an - n0)) * (s0 / n0 - (s - s0) / (an - n0)), 3) AS b FROM r WHERE an > n0)
    SELECT label, level AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY b DESC, level) = 1""")
def otsu_threshold(spark, sf):
    """(IM1)"""
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("x") + 1) * 128))).cast("int")
    px = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("x")).select("label", level.alias("level"))
    return geometry.otsu_threshold(px, "label")


@query("SELECT p_brand, round(2.0 * sum(p_size * 3) / sum(p_size + 7), 9) AS stroke FROM part GROUP BY p_brand")
def stroke_width(spark, sf):
    """(AG22)"""
    words = table(spark, sf, "part").select("p_brand", (F.col("p_size") * 3).alias("area"), (F.col("p_size") + 7).alias("boundary"))
    return geometry.stroke_width(words, "p_brand").withColumn("stroke", F.round("stroke", 9))


@query(f"""
    WITH {BOXES_SQL} SELECT label_id, line_no, round(("left" - lag("left" + width) OVER w) / CAST(30 AS DOUBLE), 6) AS gap FROM boxes WINDOW w AS (PARTITION BY label_id ORDER BY "left", line_no, top, width)""")
def word_gaps(spark, sf):
    """(WN5)"""
    words = _boxes(spark, sf).select("label_id", F.lit(0).alias("line_no"), F.struct("line_no", "top", "width").alias("word_no"), "left", "width", "height")
    return statement.word_gaps(words).select("label_id", F.col("word_no.line_no").alias("line_no"), F.round("gap", 6).alias("gap"))


# Evidence

SIGNALS_SQL = r"""
    w AS (SELECT doc_id AS label_id, w, i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)),
    c AS (SELECT *, (i * 7 + label_id) % 101 AS conf, i % 50 = 0 AS sideways FROM w)"""


def _words(spark, sf):
    w = table(spark, sf, "documents").select(F.col("doc_id").alias("label_id"), F.posexplode(F.split("text", " ")).alias("p", "text"))
    return w.select("label_id", "text", ((((F.col("p") + 1) * 7) + F.col("label_id")) % 101).cast("double").alias("conf"), ((F.col("p") + 1) % 50 == 0).alias("sideways"))


@query(rf"""
    WITH {SIGNALS_SQL} SELECT label_id, count(*) AS words, count(*) FILTER (conf >= 70 AND length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 3) AS clear_words, round_even(count(*) FILTER (conf >= 70) / count(*), 3) AS clear_share,
        round_even(avg(conf), 3) AS mean_conf, round_even(count(*) FILTER (conf < 60) / count(*), 3) AS low_share, count(*) FILTER (sideways) AS sideways FROM c GROUP BY label_id""")
def label_signals(spark, sf):
    """(AG16, FLT5)"""
    return evidence.label_signals(_words(spark, sf))


@query(rf"""
    WITH {SIGNALS_SQL} SELECT label_id, 'text' AS key, count(*) AS n, round_even(avg(conf), 3) AS mean_conf, CAST(min(conf) AS DOUBLE) AS min_conf, bool_and(NOT sideways) AS upright,
        round_even(sum(length(regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g'))) / nullif(sum(length(regexp_replace(w, '\s', '', 'g'))), 0), 3) AS plausible FROM c GROUP BY label_id""")
def field_signals(spark, sf):
    """(AG17, MA8)"""
    return evidence.field_signals(_words(spark, sf).withColumn("key", F.lit("text")))


CLARITY_SQL = f"""
    {APPS_SQL}, r AS (
        SELECT label_id, abv, unnest(['brand_name', 'alcohol_content', 'net_contents']) AS key, CASE label_id % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'NOT FOUND' ELSE 'NEAR MATCH' END AS verdict, label_id % 10 < 7 AS well, abv * 2.0 AS conf FROM apps
    ), j AS (
        SELECT *, CASE WHEN verdict NOT IN ('MISMATCH', 'NOT FOUND') THEN NULL WHEN key <> 'brand_name' AND verdict = 'MISMATCH' THEN true WHEN verdict = 'NOT FOUND' THEN well ELSE conf >= 80 END AS clear FROM r
    )"""


def _judged(spark, sf):
    apps = applications(spark, sf)
    kinds = F.array(*[F.lit(x) for x in ("MATCH", "MISMATCH", "NOT FOUND", "NEAR MATCH")])
    well = F.col("label_id") % 10 < 7
    rows = apps.select("label_id", "abv", F.explode(F.array(*[F.lit(k) for k in ("brand_name", "alcohol_content", "net_contents")])).alias("key"))
    rows = rows.withColumns({
        "expected": F.lit("value"), "result": F.struct(F.element_at(kinds, (F.col("label_id") % 4 + 1).cast("int")).alias("verdict"), F.lit("x").alias("code"), F.lit("found it").alias("found")),
        "label": F.struct(F.lit(50).alias("words"), F.when(well, 0.95).otherwise(0.5).alias("clear_share"), F.when(well, 0.05).otherwise(0.4).alias("low_share")),
        "field": F.struct((F.col("abv") * 2.0).alias("mean_conf"), F.lit(60.0).alias("min_conf"), F.lit(1.0).alias("plausible"), F.lit(True).alias("upright")),
    })
    return rows.withColumn("clear", evidence.judge_clarity())


@query(f"WITH {CLARITY_SQL} SELECT label_id, key, clear FROM j")
def clarity(spark, sf):
    """(EV1, EV2)"""
    return _judged(spark, sf).select("label_id", "key", "clear")


@query(f"""
    WITH {CLARITY_SQL}, g AS (
        SELECT label_id, bool_or(verdict IN ('MISMATCH', 'NOT FOUND') AND clear IS DISTINCT FROM false) AS f, bool_or(verdict <> 'MATCH') AS look, count(*) FILTER (verdict IN ('MISMATCH', 'NOT FOUND') AND clear IS NOT DISTINCT FROM false) AS u,
            label_id % 3 = 0 AS wf, label_id % 2 = 0 AS wu FROM j GROUP BY label_id
    ) SELECT label_id, CASE WHEN f OR (wf AND NOT wu) THEN 'FAIL' WHEN look OR wf THEN 'REVIEW' ELSE 'PASS' END AS overall, u + CAST(wf AND wu AS INT) >= 2 AS poor_image FROM g""")
def overall_status(spark, sf):
    """(EV4, EV5)"""
    fields = _judged(spark, sf)
    warnings = applications(spark, sf).select("label_id", F.when(F.col("label_id") % 3 == 0, "FAIL").otherwise("PASS").alias("overall"), (F.col("label_id") % 2 != 0).alias("clear"))
    return evidence.roll_up(fields, warnings).select("label_id", "overall", "poor_image")


@query(f"""
    WITH {CLARITY_SQL}, g AS (
        SELECT label_id, min(verdict) AS verdict, list(replace(replace(replace(key, 'brand_name', 'brand name'), 'alcohol_content', 'alcohol content'), 'net_contents', 'net contents') ORDER BY key = 'net_contents', key <> 'brand_name') FILTER (verdict IN ('MISMATCH', 'NOT FOUND') AND clear IS DISTINCT FROM false) AS p,
            list(replace(replace(replace(key, 'brand_name', 'brand name'), 'alcohol_content', 'alcohol content'), 'net_contents', 'net contents') ORDER BY key = 'net_contents', key <> 'brand_name') FILTER (verdict IN ('MISMATCH', 'NOT FOUND') AND clear IS NOT DISTINCT FROM false) AS u FROM j GROUP BY label_id
    ) SELECT label_id, CASE WHEN verdict = 'MATCH' THEN 'All 3 fields match the application and the government warning is correct.' ELSE concat_ws('. ', CASE WHEN len(u) >= 2 THEN 'Much of this label could not be read clearly' END,
        CASE WHEN len(p) > 0 THEN len(p) || CASE WHEN len(p) > 1 THEN ' problems: ' ELSE ' problem: ' END || array_to_string(p, ', ') END, CASE WHEN len(u) > 0 THEN 'Could not be read clearly: ' || array_to_string(u, ', ') END,
        CASE WHEN verdict = 'NEAR MATCH' THEN 'Needs a look: brand name, alcohol content, net contents' END) || '.' END AS summary FROM g""")
def summary(spark, sf):
    """(EV6)"""
    warnings = applications(spark, sf).select("label_id", F.lit("PASS").alias("overall"), F.lit(None).cast("boolean").alias("clear"))
    return evidence.roll_up(_judged(spark, sf), warnings).select("label_id", "summary")


@query(f"""WITH {CLARITY_SQL} SELECT label_id, key, CASE WHEN verdict <> 'NOT FOUND' THEN sum(CAST(verdict <> 'NOT FOUND' AS INT)) OVER (PARTITION BY label_id ORDER BY key) END AS pin FROM r""")
def pin_numbers(spark, sf):
    """(EV12)"""
    rows = _judged(spark, sf).select("label_id", "key", F.col("key").alias("ord"), (F.col("result.verdict") != "NOT FOUND").alias("has_box"))
    return evidence.pin_numbers(rows).select("label_id", "key", "pin")


@query(f"""WITH {APPS_SQL} SELECT label_id, unnest(['application', 'label', 'difference']) AS row, CAST(unnest([abv, abv + label_id % 3, label_id % 3]) AS DOUBLE) AS value FROM apps""")
def evidence_rows(spark, sf):
    """(EV11)"""
    rows = applications(spark, sf).select("label_id", F.lit("alcohol_content").alias("key"), F.col("abv").alias("expected_value"), (F.col("abv") + F.col("label_id") % 3).alias("found_value"))
    return evidence.evidence_rows(rows).select("label_id", "row", "value")


@query(f"""WITH {CLARITY_SQL} SELECT label_id, key, verdict = 'NEAR MATCH' AS lean FROM j WHERE verdict = 'NEAR MATCH' OR (verdict IN ('MISMATCH', 'NOT FOUND') AND clear IS NOT DISTINCT FROM false)""")
def review_questions(spark, sf):
    """(EV13)"""
    return evidence.review_questions(_judged(spark, sf)).select("label_id", "key", "lean")


# Passages


@query(rf"""
    WITH {LOOSE_SQL}, b AS (SELECT item_id, text FROM benchmark), bl AS (
        SELECT item_id, trim(regexp_replace(array_to_string(list_transform(range(2, len(c)), lambda i: CASE WHEN regexp_matches(c[i], '[\p{{L}}\p{{N}}\p{{M}}\s%]') THEN c[i] ELSE ' ' END), ''), '\s+', ' ', 'g')) AS p
        FROM (SELECT item_id, string_split(' ' || lower(strip_accents(text)) || ' ', '') AS c FROM b)
    ) SELECT doc_id, item_id FROM loose, bl WHERE contains(' ' || loose || ' ', ' ' || p || ' ') AND p <> ''""")
def passage_conformance(spark, sf):
    """Documents that hold a mandated passage word for word. (WR10, WR13)"""
    return passage.contains_passage(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'FAIL' ELSE 'FAIL' END AS status, CASE WHEN item_id % 4 = 0 THEN 0 ELSE 1 END AS differences FROM benchmark")
def passage_word_diff(spark, sf):
    """Passages with one edit: a case change, a letter, a negation, a long insertion. (WR9, WR11, WR13)"""
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("every word of this text should stand as it is printed here "), F.lit("and no other word may take its place in it ")).alias("text"))
    edit = lambda a, c: F.replace("text", F.lit(a), F.lit(c))
    found = F.element_at(F.array(F.upper("text"), edit("printed", "prlnted"), edit("should stand", "should not stand"), F.concat("text", F.lit("x" * 80))), (F.col("item_id") % 4 + 1).cast("int"))
    rows = passage.check_wording(b.withColumn("found_text", found), F.col("text"), ("every word", "no other word"))
    return rows.select("item_id", "status", F.size("differences").alias("differences"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'REVIEW' ELSE 'FAIL' END AS status FROM benchmark")
def heading_caps(spark, sf):
    """(WR14)"""
    text = F.element_at(F.array(*[F.lit(x) for x in ("GOVERNMENT WARNING: (1)", "Government Warning: (1)", "GOVERNMENT WARNING (1)", "HEALTH WARNING: (1)")]), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", passage.heading_caps(text).alias("status"))


@query("SELECT item_id AS label_id, 2 AS start_line, sha256('GOVERNMENT WARNING: ' || text) AS found FROM (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM benchmark)")
def statement_assembly(spark, sf):
    """(WR1, WR2)"""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("label_id"), F.split(F.regexp_replace("text", r"\s+", " "), " ").alias("w"))
    text = F.concat(F.array(F.lit("brand"), F.lit("class"), F.concat(F.lit("GOVERNMENT WARNING: "), F.get("w", F.lit(0)))), F.slice("w", F.lit(2), F.size("w")))
    found = passage.assembled_statements(b.select("label_id", F.posexplode(text).alias("line_no", "text")))
    return found.select("label_id", "start_line", F.sha2("found_text", 256).alias("found"))


#: Edits of the mandated text, and what check_wording says of them.
EDITS = (("not drink", "drink", "FAIL"), ("may cause", "can cause", "FAIL"), ("women", "wornen", "REVIEW"), ("impairs", "impair", "REVIEW"), ("problems", "benefits", "FAIL"), ("may cause", "may never cause", "FAIL"), ("GOVERNMENT", "Government", "PASS"))


def _read_pages(spark, sf):
    """(words, statements): a page a customer, with one edit of the mandated text in lines of nine words, and a neighbouring column beside two of them."""
    n, pages = F.col("c_custkey"), dealt(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    text = F.element_at(F.array(*[F.lit(MANDATED.replace(a, b, 1)) for a, b, _ in EDITS]), (n % len(EDITS) + 1).cast("int"))
    rows = pages.select(n.alias("label_id"), F.posexplode(F.split(text, " ")).alias("i", "text"))
    rows = rows.select("label_id", F.floor(F.col("i") / 9).cast("int").alias("line_no"), (F.col("i") % 9).cast("int").alias("word_no"), "text", (F.col("i") % 9 * 150).cast("int").alias("left"), F.lit(145).alias("width"))
    beside = F.array(F.struct(F.lit(1).alias("line_no"), F.lit("Imported").alias("text")), F.struct(F.lit(2).alias("line_no"), F.lit("Lisbon").alias("text")))
    column = pages.select(n.alias("label_id"), F.inline(beside)).select("label_id", "line_no", F.lit(90).alias("word_no"), "text", F.lit(1500).alias("left"), F.lit(90).alias("width"))
    words = rows.union(column).withColumns({"top": 30 * F.col("line_no"), "height": F.lit(20), "conf": F.lit(95.0), "view": F.lit(0)})
    lines_ = F.transform(F.sequence(F.lit(0), F.lit((len(MANDATED.split()) - 1) // 9)), lambda x: x.cast("int"))
    return words, pages.select(n.alias("label_id"), lines_.alias("lines"), F.lit("").alias("found_text"), F.lit("").alias("beside"))


@query(f"SELECT c_custkey AS label_id, 'Imported Lisbon' AS beside, ({list(x[2] for x in EDITS)})[c_custkey % {len(EDITS)} + 1] AS status FROM customer")
def meaning_changes(spark, sf):
    """Statements cut to their column, and what surely read differences mean. (WR3, WR11, WR12, WR13)"""
    words, found = _read_pages(spark, sf)
    found = statement.token_words(words, statement.cut_to_column(words, found))
    return passage.check_wording(found, tokens="token_words").select("label_id", "beside", "status")


@query("SELECT c_custkey AS label_id, 2 AS line_no, 'effects.' AS text, 'defects.' AS kept_text FROM customer")
def conflicting_words(spark, sf):
    """A second reading of the third line, in which one word differs. (WR5)"""
    words, found = _read_pages(spark, sf)
    second = words.where("line_no = 2").withColumns({"line_no": F.lit(20), "text": F.when(F.col("text") == "defects.", "effects.").otherwise(F.col("text"))})
    return statement.conflicting_words(words.unionByName(second), found).select("label_id", (F.col("line_no") - 18).alias("line_no"), "text", "kept_text")


# Lines of several readings


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), d AS (SELECT doc_id, i, t FROM l WHERE trim(t, ' ') <> '')
    SELECT doc_id AS label_id, count(*) + 1 AS n FROM d GROUP BY doc_id""")
def merge_two_passes(spark, sf):
    """The second pass reads every line again, with other blanks, and one that is new. (ST1-ST3)"""
    first = lines.document_lines(table(spark, sf, "documents"))
    again = first.withColumn("text", F.concat(F.lit(" "), "text", F.lit("  ")))
    new = first.select("label_id").distinct().select("label_id", F.lit(9999).alias("line_no"), F.lit("a line that is new to it").alias("text"))
    merged = lines.merge_passes(first, again.unionByName(new).unionByName(new.withColumn("line_no", F.lit(10000))))
    return merged.groupBy("label_id").agg((F.max("new_line") + 1).cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS p_name FROM part")
def registry_upsert(spark, sf):
    """(JN11)"""
    old = table(spark, sf, "part").select("p_partkey", "p_name")
    return lines.upsert(old, old.where("p_partkey % 3 = 0").withColumn("p_name", F.lit("new")), "p_partkey")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'not in registry' END AS reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey + 10")
def transcripts_with_reasons(spark, sf):
    """The registry's keys are shifted, so that it really lacks some. (JN4)"""
    right = table(spark, sf, "customer").select((F.col("c_custkey") + 10).alias("o_custkey"))
    return lines.with_reasons(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), right, "o_custkey").select("o_orderkey", "reason")


@query("SELECT l_orderkey AS label_id, l_linenumber AS line_no FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_tax > 0.03 AS INT) DESC, l_linenumber, l_partkey) <= 4")
def reread_candidates(spark, sf):
    """(SO4)"""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("label_id"), F.col("l_linenumber").alias("line_no"), (F.col("l_tax") > 0.03).alias("sure"))
    return lines.reread_candidates(rows, 4).select("label_id", "line_no")


# Batches


@query(f"""
    WITH {APPS_SQL} SELECT label_id, CASE label_id % 6 WHEN 1 THEN ['missing brand_name'] WHEN 2 THEN ['unreadable alcohol_content'] WHEN 3 THEN ['missing class_type', 'unreadable net_contents'] ELSE [] END AS errors FROM apps""")
def row_validation(spark, sf):
    """(FLT1, FLT2)"""
    k = F.col("label_id") % 6
    rows = applications(spark, sf).withColumns({"brand_name": F.when(k == 1, " ").otherwise(F.col("brand_name")), "alcohol_content": F.when(k == 2, "some").otherwise(F.col("alcohol_content")), "class_type": F.when(k == 3, "").otherwise(F.col("class_type")), "net_contents": F.when(k == 3, "SOIL").otherwise(F.col("net_contents"))})
    rows = rows.withColumns({"a": figures.alcohol_value("alcohol_content"), "v": figures.volume_value("net_contents")})
    return rows.select("label_id", batch.row_errors({c: F.col(c) for c in ("brand_name", "class_type", "alcohol_content", "net_contents")}, F.col("a"), F.col("v")).alias("errors"))


@query("SELECT p_partkey AS application_id, p_name AS brand_name, p_type AS class_type FROM part")
def header_alias(spark, sf):
    """(SRC2, SF21)"""
    odd = table(spark, sf, "part").select(F.col("p_partkey").alias("Application ID"), F.col("p_name").alias("﻿Brand-Name"), F.col("p_type").alias("CLASS / TYPE"))
    return batch.map_headers(odd, readers.ALIASES)


FILES_SQL = """
    f AS (SELECT doc_id, 'img' || (doc_id % 700) || CASE WHEN doc_id % 700 >= 500 AND doc_id >= 700 THEN '.jpg' ELSE '.PNG' END AS path, md5(CASE WHEN doc_id % 700 < 100 THEN 'same' ELSE CAST(doc_id AS VARCHAR) END) AS digest FROM documents),
    files AS (SELECT lower(path) AS name, split_part(lower(path), '.', 1) AS stem, CASE WHEN min(digest) = max(digest) THEN min(digest) END AS digest FROM f GROUP BY lower(path)),
    stems AS (SELECT stem, count(*) AS n, min(name) AS name, min(digest) AS digest FROM files GROUP BY stem),
    named AS (SELECT p_partkey, 'img' || (p_partkey % 900) || CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '' ELSE '.jpg' END AS file_name FROM part),
    joined AS (
        SELECT p_partkey, file_name, CASE WHEN e.name IS NOT NULL THEN CASE WHEN e.digest IS NULL THEN 'ambiguous' ELSE 'ok' END WHEN s.stem IS NULL THEN 'missing' WHEN s.n > 1 OR s.digest IS NULL THEN 'ambiguous' ELSE 'ok' END AS state, coalesce(e.name, s.name) AS f
        FROM named LEFT JOIN files e ON e.name = lower(file_name) LEFT JOIN stems s ON s.stem = split_part(lower(file_name), '.', 1)
    )"""


def _files(spark, sf):
    i = F.col("doc_id")
    path = F.concat(F.lit("some/Folder/img"), (i % 700).cast("string"), F.when((i % 700 >= 500) & (i >= 700), ".jpg").otherwise(".PNG"))
    return batch.collected_files(table(spark, sf, "documents").select(path.alias("path"), F.md5(F.when(i % 700 < 100, "same").otherwise(i.cast("string"))).alias("digest")))


def _named(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("img"), (k % 900).cast("string"), F.element_at(F.array(F.lit(".png"), F.lit(""), F.lit(".jpg")), (k % 3 + 1).cast("int"))).alias("file_name"))


@query(f"WITH {FILES_SQL} SELECT name, digest IS NULL AS ambiguous FROM files")
def duplicate_files(spark, sf):
    """(SRC4, ST4)"""
    return _files(spark, sf).select("name", F.col("digest").isNull().alias("ambiguous"))


@query(f"WITH {FILES_SQL} SELECT p_partkey, state, CASE WHEN state = 'ok' THEN f END AS file FROM joined")
def keyed_file_join(spark, sf):
    """(JN1)"""
    return batch.join_files(_named(spark, sf), _files(spark, sf)).select("p_partkey", "state", "file")


@query(f"""
    WITH {FILES_SQL} SELECT name FROM files WHERE digest IS NOT NULL AND name NOT IN (SELECT f FROM joined WHERE state = 'ok') AND name NOT IN (SELECT lower(file_name) FROM named)
        AND stem NOT IN (SELECT split_part(lower(file_name), '.', 1) FROM named)""")
def orphan_files(spark, sf):
    """(JN3)"""
    files, named = _files(spark, sf), _named(spark, sf)
    return batch.orphans(files, batch.join_files(named, files).where("state = 'ok'"), named)


@query("""
    SELECT p_partkey AS row_id, CASE p_partkey % 6 WHEN 0 THEN 'bad row' WHEN 1 THEN 'no image' WHEN 2 THEN 'too many images' WHEN 3 THEN 'image missing' WHEN 4 THEN 'image ambiguous' END AS error,
        CASE WHEN p_partkey % 6 = 5 THEN 2 ELSE 0 END AS n FROM part""")
def build_items(spark, sf):
    """(JN2, AR1)"""
    files = spark.createDataFrame([("a.png", "1"), ("b.png", "2"), ("c.png", "3"), ("x/c.png", "4")], "path string, digest string")
    image = F.element_at(F.array(*[F.lit(x) for x in ("a.png", " ; | ", "a;a;a;a;a;a;a", "a.png; nope.png", "b|c.png", "B.PNG | a")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), image.alias("image"), F.when(F.col("p_partkey") % 6 == 0, "bad row").alias("error"))
    return batch.build_items(rows, batch.collected_files(files)).select("row_id", "error", F.coalesce(F.size("files"), F.lit(0)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderstatus = 'F' OR o_custkey % 5 = 0)")
def export_scope(spark, sf):
    """(FLT3, FLT12)"""
    items = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("application_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 5 == 0, "pass").alias("decision"))
    return batch.export_scope(items, ["1-URGENT", "2-HIGH"], batch.parse_scope("f, cleared,")).select("o_orderkey")


@query("""
    WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE chr(9) END || text AS cell FROM documents)
    SELECT doc_id, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || cell ELSE cell END AS cell FROM t""")
def export_guard(spark, sf):
    """(SNK2)"""
    cell = F.concat(F.element_at(F.array(F.lit("="), F.lit("-"), F.lit(""), F.lit("\t")), (F.col("doc_id") % 4 + 1).cast("int")), "text")
    return table(spark, sf, "documents").select("doc_id", batch.guarded(cell).alias("cell"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority || ' ' || o_orderkey || ' ' || o_custkey), '-high')")
def search_filter(spark, sf):
    """(FLT4)"""
    return batch.search(table(spark, sf, "orders").withColumn("status", F.col("o_orderstatus")), "-HIGH", "O", ("o_orderpriority", "o_orderkey", "o_custkey")).select("o_orderkey")


@query(f"""
    WITH {APPS_SQL}, f AS (SELECT label_id, unnest(['brand_name', 'net_contents']) AS key, unnest([brand_name, '=' || net_contents]) AS e FROM apps)
    SELECT label_id AS application_id, max(CASE WHEN key = 'brand_name' THEN e END) AS brand_name_expected, '''' || max(CASE WHEN key = 'net_contents' THEN e END) AS net_contents_expected FROM f GROUP BY label_id""")
def export_table(spark, sf):
    """(SNK1)"""
    apps = applications(spark, sf)
    fields = apps.select(F.col("label_id").alias("application_id"), F.explode(F.array(F.struct(F.lit("brand_name").alias("key"), F.col("brand_name").alias("expected")), F.struct(F.lit("net_contents").alias("key"), F.concat(F.lit("="), F.col("net_contents")).alias("expected")))).alias("f"))
    fields = fields.select("application_id", "f.*", F.lit("x").alias("found"), F.lit("MATCH").alias("verdict"), F.lit(100).alias("score"))
    return batch.export_table(apps.select(F.col("label_id").alias("application_id")), fields).select("application_id", "brand_name_expected", "net_contents_expected")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'a-' END AS prefix, o_custkey % 113 AS number FROM orders")
def natural_sort_keys(spark, sf):
    """(SO3)"""
    name = F.concat(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("a-")), (F.col("o_orderkey") % 3 + 1).cast("int")), (F.col("o_custkey") % 113).cast("string"), F.lit(".png"))
    prefix, number, _ = batch.natural_order(name)
    return table(spark, sf, "orders").select("o_orderkey", prefix.alias("prefix"), number.cast("long").alias("number"))


# Review answers


@query(f"WITH {ANSWERS_SQL} SELECT job, application_id, key, decision, seq FROM standing")
def latest_answers(spark, sf):
    """(WN1)"""
    return review.latest_answers(answer_log(spark, sf)).select("job", "application_id", "key", "decision", "seq")


@query(f"""
    WITH {ANSWERS_SQL} SELECT job, application_id, CASE WHEN bool_or(decision = 'fail') THEN 'fail' WHEN bool_and(decision = 'pass') THEN 'pass' ELSE 'skip' END AS decision, string_agg(key || ': ' || decision, '; ' ORDER BY key) AS answers FROM standing GROUP BY job, application_id""")
def label_decision(spark, sf):
    """(MP1-MP3)"""
    rows = review.answer_maps(review.latest_answers(answer_log(spark, sf)))
    return rows.select("job", "application_id", review.label_decision(F.col("answers")).alias("decision"), review.answers_text(F.col("answers")).alias("answers"))


@query(f"""
    WITH {ANSWERS_SQL}, raised AS (SELECT key, count(*) AS raised FROM (SELECT DISTINCT job, application_id, key FROM standing UNION SELECT DISTINCT job, application_id, 'net_contents' FROM standing) GROUP BY key),
    asked AS (SELECT key, count(*) AS asked, count(*) FILTER (decision = 'pass') AS pass, count(*) FILTER (decision = 'fail') AS fail, count(*) FILTER (decision = 'skip') AS skip FROM standing GROUP BY key)
    SELECT key, coalesce(raised, 0) AS raised, coalesce(asked, 0) AS asked, coalesce(pass, 0) AS pass, coalesce(fail, 0) AS fail, coalesce(skip, 0) AS skip, CASE WHEN pass + fail > 0 THEN pass / (pass + fail) END AS pass_rate FROM raised FULL JOIN asked USING (key)""")
def question_summary(spark, sf):
    """(AG4, JN12)"""
    return review.question_summary(with_prompts(review.latest_answers(answer_log(spark, sf))))


@query(f"""
    WITH {ANSWERS_SQL} SELECT key, CASE WHEN key = 'brand_name' THEN 'note ' || seq % 3 ELSE 'is ' || key || ' right?' END AS note, count(*) AS n, min(seq) AS first_seq FROM standing WHERE decision = 'fail' GROUP BY ALL ORDER BY n DESC, first_seq LIMIT 10""")
def top_notes(spark, sf):
    """(AG5, JN10)"""
    return review.top_notes(with_prompts(review.latest_answers(answer_log(spark, sf))), "fail")


@query(f"""
    WITH {ANSWERS_SQL}, g AS (
        SELECT job, application_id, arg_max(decision, struct_pack(t := ts, s := -seq)) AS decision, list(key || '=review' ORDER BY seq) FILTER (decision = 'pass' AND key <> 'warning_wording') AS e, string_agg(decision || ': is ' || key || ' right?', ' | ' ORDER BY seq) AS notes
        FROM standing GROUP BY job, application_id
    ) SELECT job, application_id, decision, coalesce(array_to_string(e, ';'), '') AS expect, notes FROM g WHERE decision IN ('pass', 'fail')""")
def calibration_rows(spark, sf):
    """(AG6)"""
    return review.calibration_rows(with_prompts(review.latest_answers(answer_log(spark, sf))))


ITEMS_SQL = "items AS (SELECT o_orderkey AS idx, o_custkey % 7 AS job, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'REVIEW' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'ERROR' WHEN o_orderkey % 3 = 1 THEN 'FAIL' ELSE 'PENDING' END END AS status, floor(o_totalprice) AS total_ms, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS decision FROM orders)"


def _items(spark, sf):
    k = F.col("o_orderkey") % 3
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "REVIEW").when(k == 0, "ERROR").when(k == 1, "FAIL").otherwise("PENDING")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 7).alias("job"), status.alias("status"), F.floor("o_totalprice").alias("total_ms"), F.when(F.col("o_orderkey") % 4 == 0, "pass").when(F.col("o_orderkey") % 4 == 1, "fail").alias("decision"))


@query(f"WITH {ITEMS_SQL} SELECT job, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'ERROR') AS error FROM items GROUP BY job")
def status_counts(spark, sf):
    """(AG1)"""
    return review.status_counts(_items(spark, sf))


@query(f"""
    WITH {ITEMS_SQL}, g AS (SELECT job, count(*) AS total, count(*) FILTER (status <> 'PENDING') AS processed, round_even(avg(total_ms) FILTER (status <> 'PENDING'), 3) AS per_label_ms, count(decision) AS decided, count(*) FILTER (decision = 'pass') AS cleared FROM items GROUP BY job)
    SELECT *, CASE WHEN processed >= 10 THEN round_even(per_label_ms * (total - processed), 3) END AS eta_ms FROM g""")
def job_progress(spark, sf):
    """(AG2, AG3)"""
    return review.job_progress(_items(spark, sf))


@query(f"WITH {ITEMS_SQL} SELECT job, idx, row_number() OVER (PARTITION BY job ORDER BY CASE status WHEN 'REVIEW' THEN 0 WHEN 'FAIL' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'PASS' THEN 3 ELSE 4 END, idx) AS place FROM items")
def triage_order(spark, sf):
    """(SO1, SO2)"""
    return review.triage(_items(spark, sf)).select("job", "idx", "place")


@query("SELECT event_id AS job FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR ORDER BY ts DESC, event_id DESC LIMIT 50")
def prune_jobs(spark, sf):
    """(WN4, DT2)"""
    jobs = table(spark, sf, "events").select(F.col("event_id").alias("job"), F.col("ts").alias("created_at"))
    return review.prune_jobs(jobs, F.lit("2024-01-20").cast("timestamp")).select("job")


# Scoring

SCORED_SQL = """
    s AS (SELECT d.doc_id AS id, lang AS kind, CASE WHEN quality = 1 THEN 'match' ELSE 'review' END AS wanted, CASE d.doc_id % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'NEAR MATCH' WHEN 2 THEN 'MISMATCH' ELSE 'NOT FOUND' END AS verdict FROM documents d JOIN labels l USING (doc_id)),
    o AS (SELECT *, CASE WHEN (wanted = 'match' AND verdict = 'MATCH') OR (wanted = 'review' AND verdict = 'NEAR MATCH') THEN 'right' WHEN verdict = 'NEAR MATCH' THEN 'conservative' WHEN verdict = 'MATCH' THEN 'accepted' ELSE 'false_alarm' END AS outcome FROM s)"""


def _scored(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("MATCH", "NEAR MATCH", "MISMATCH", "NOT FOUND")])
    results = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("brand_name").alias("key"), F.lit("value").alias("expected"), F.col("lang").alias("kind"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("verdict"))
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "").otherwise("brand_name=review;net_contents=absent").alias("expect"))
    return scoring.score_fields(results, truth)


@query(f"WITH {SCORED_SQL} SELECT id, wanted, outcome FROM o")
def score_fields(spark, sf):
    """(JN9, AG7, PR9)"""
    return _scored(spark, sf).select("id", "wanted", "outcome")


@query(f"WITH {SCORED_SQL} SELECT kind, count(*) AS n, count(*) FILTER (outcome = 'right') AS \"right\", count(*) FILTER (outcome = 'conservative') AS conservative, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'false_alarm') AS false_alarm FROM o GROUP BY ROLLUP (kind)")
def score_rollup(spark, sf):
    """(AG7, AG8)"""
    return scoring.tally(_scored(spark, sf), "kind")


@query(f"""
    WITH {APPS_SQL} SELECT defect, count(*) AS planted, count(*) FILTER (defect IN ('abv', 'volume', 'no_alcohol', 'proof')) AS caught,
        count(*) FILTER (defect IN ('case', 'letter') OR (defect = 'lost_point' AND net_contents LIKE '%.%')) AS review, count(*) FILTER (defect = 'none' OR (defect = 'lost_point' AND net_contents NOT LIKE '%.%')) AS passed FROM apps GROUP BY defect""")
def planted_audit(spark, sf):
    """No planted defect passes, but a point that was not there to lose. (AG9, GEN3)"""
    apps = applications(spark, sf)
    found = plans.verify(apps, label_lines(apps)).select("label_id", F.col("overall").alias("status"))
    return scoring.planted_audit(apps.select("label_id", "defect").join(shuffled(found), "label_id"))


@query("SELECT l_shipmode AS mode, v AS at_rank FROM (SELECT l_returnflag AS l_shipmode, list_sort(list(l_extendedprice)) AS s FROM lineitem GROUP BY l_returnflag), LATERAL (SELECT s[CAST(floor(0.95 * (len(s) - 1)) AS INT) + 1] AS v)")
def p95_by_rank(spark, sf):
    """(AG10)"""
    return scoring.p95(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "mode"), "l_extendedprice", "mode")


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS INT) + 1] AS at_rank FROM lineitem GROUP BY l_returnflag")
def upper_median(spark, sf):
    """(AG11)"""
    return scoring.upper_median(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def mix_counts(spark, sf):
    """(AG25)"""
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("""
    WITH d AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Straight Whiskey' WHEN 1 THEN 'RED WINE' WHEN 2 THEN 'pale ale' WHEN 3 THEN 'ginger water' ELSE 'gin' END AS t FROM part)
    SELECT p_partkey, CASE t WHEN 'Straight Whiskey' THEN 'spirits' WHEN 'RED WINE' THEN 'wine' WHEN 'pale ale' THEN 'beer' WHEN 'gin' THEN 'spirits' ELSE 'other' END AS kind FROM d""")
def kind_of(spark, sf):
    """(SF22)"""
    text = F.element_at(F.array(*[F.lit(x) for x in ("Straight Whiskey", "RED WINE", "pale ale", "ginger water", "gin")]), F.col("p_size") % 5 + 1)
    return table(spark, sf, "part").select("p_partkey", readers.kind_of(text).alias("kind"))


@query("""
    WITH f AS (SELECT p_brand, p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_type) = 1),
    t AS (SELECT p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY md5('1:' || p_brand), p_brand) AS INTEGER) AS turn FROM f)
    SELECT p_brand, p_type, turn FROM t ORDER BY turn, p_type LIMIT 20""")
def stratified_sample(spark, sf):
    """Twenty parts, in turn from each type, one a brand. (WN6)"""
    return scoring.stratified(table(spark, sf, "part").select("p_brand", "p_type", "p_partkey"), "p_brand", ["p_type"], 20).select("p_brand", "p_type", "turn")


# Pages


@query(r"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|title|nav|head|body|html)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM b)
    SELECT page_id, sha256(trim(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ')) AS text FROM c""")
def html_to_text(spark, sf):
    """(SRC11)"""
    return table(spark, sf, "pages").select("page_id", F.sha2(readers.html_text(F.col("html")), 256).alias("text"))


@query("SELECT page_id, CAST(page_id % 100 AS VARCHAR) || ' proof' AS alcohol, CASE WHEN page_id % 2 = 0 THEN 'x' END AS fanciful FROM pages")
def page_fields(spark, sf):
    """(SRC12)"""
    text = F.concat(F.lit("Registry\nAlcohol: "), (F.col("page_id") % 100).cast("string"), F.lit(" proof \nFanciful Name:"), F.when(F.col("page_id") % 2 == 0, " x").otherwise(""))
    return table(spark, sf, "pages").select("page_id", readers.labelled_field(text, "Alcohol").alias("alcohol"), readers.labelled_field(text, "Fanciful Name").alias("fanciful"))


# Streams


def _stream(spark, sf):
    base = table(spark, sf, "events")
    raw = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parque[t]")
    k = F.get_json_object("props", "$.k").cast("int")
    keys = F.array(*[F.lit(x) for x in ("brand_name", "class_type", "alcohol_content", "net_contents", "warning_wording")])
    decision = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "click", "fail").when(F.col("event_type") == "view", "skip").when(F.col("event_type") == "error", "clear").otherwise("pass")
    return raw.select((F.col("user_id") % 10).alias("job"), F.col("user_id").alias("application_id"), F.element_at(keys, (k % 5 + 1).cast("int")).alias("key"), decision.alias("decision"), F.to_timestamp(F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z"))).alias("ts"), F.col("event_id").alias("seq"))


def _folders(spark, name):
    """Where a stream's table and its progress are kept: new ones for each run of a query."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{folder}/table", f"{folder}/progress"


@query(f"WITH {ANSWERS_SQL} SELECT job, application_id, key, decision, seq FROM standing")
def stream_latest_answers(spark, sf):
    """(STR1)"""
    from .streaming import answers

    return answers.standing_answers(_stream(spark, sf), *_folders(spark, "answers")).where("decision is not null").select("job", "application_id", "key", "decision", "seq")


@query(f"WITH {ANSWERS_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, decision, count(*) AS n FROM answers GROUP BY ALL")
def stream_answer_counts(spark, sf):
    """(STR2)"""
    from .streaming import answers

    return answers.counted_answers(_stream(spark, sf), *_folders(spark, "counts"))


@query(ORACLE_SQL["label_signals"])
def stream_document_signals(spark, sf):
    """Documents as they arrive, each scored by itself. (STR3)"""
    from .streaming import answers

    base = table(spark, sf, "documents")
    raw = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/documents.parque[t]")
    word = lambda w, p: F.struct(w.alias("text"), ((((p + 1) * 7) + F.col("doc_id")) % 101).cast("double").alias("conf"), ((p + 1) % 50 == 0).alias("sideways"))
    arriving = raw.select(F.col("doc_id").alias("label_id"), F.lit(0).alias("seq"), F.transform(F.split("text", " "), word).alias("words"))
    return answers.scored_documents(arriving, *_folders(spark, "signals")).drop("seq")


from . import page_queries  # noqa: E402, F401  registers more queries with query()
