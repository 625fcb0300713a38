"""Registered queries over pages as they were read: whole checks, statements, evidence and closer readings. veriloom.queries imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from .config import FIELD_KEYS, MANDATED
from .operators import evidence, lines, passage, rereads, review, statement, words as traced
from .plans import generate, pages as plans, verify
from .plans.projections import APPS_SQL, applications, label_lines, table
from .sources import readers
from .sources.shared import checkpointed, dealt, shuffled
from .queries import BOXES_SQL, LCS_SQL, _boxes, query

WORDS = MANDATED.split()
QUOTED = MANDATED.replace("'", "''")


# The whole check (API1, MT12, WR18)

#: Edits of the statement on a label; the last label has none.
STATEMENT_EDITS = ((None, None), ("not drink", "drink"), ("women", "wornen"), ("GOVERNMENT WARNING:", "Government Warning:"))


def _page_words(apps):
    """Words of labels: the lines of label_lines(), the statement in lines of nine words, closer readings as line 50. A seventh of the labels is read badly."""
    key = F.col("label_id")
    text = F.lit(None).cast("string")
    for k, (a, b) in enumerate(STATEMENT_EDITS):
        text = F.when(key % 5 == k, F.lit(MANDATED if a is None else MANDATED.replace(a, b, 1))).otherwise(text)
    body = apps.select("label_id", F.posexplode(F.split(text, " ")).alias("i", "text"))
    body = body.select("label_id", (5 + F.floor(F.col("i") / 9)).cast("int").alias("line_no"), (F.col("i") % 9).cast("int").alias("word_no"), "text", (F.col("i") < 2).alias("heading"))
    front = lines.line_words(label_lines(apps).unionByName(_page_rereads(apps).select("label_id", F.col("new_line").alias("line_no"), "text"))).withColumn("heading", F.lit(False))
    rows = front.unionByName(body.select(*front.columns))
    tall = F.when(F.col("line_no") == 0, 60).otherwise(20)
    bold = F.col("heading") & (key % 11 != 0)
    return rows.select(
        "label_id", "line_no", "word_no", "text", F.when(key % 7 == 0, 50.0).otherwise(95.0).alias("conf"), F.lit(False).alias("sideways"), F.lit("upright").alias("frame"), F.lit(0).alias("view"),
        (150 * F.col("word_no")).cast("int").alias("left"), (70 * F.col("line_no")).cast("int").alias("top"), F.lit(145).alias("width"), tall.alias("height"), F.when(bold, 400).otherwise(200).alias("area"), F.lit(200).alias("boundary"),
    )


def _page_rereads(apps):
    """A closer reading of the alcohol line of a third of the labels with a wrong percentage; it says what the application says."""
    text = F.concat(F.lit("ALC. "), F.col("abv").cast("string"), F.lit("% BY VOL. ("), (2 * F.col("abv")).cast("string"), F.lit(" PROOF)"))
    return apps.where("defect = 'abv' and label_id % 3 = 0").select("label_id", F.lit(0).alias("seq"), F.lit(2).alias("line_no"), F.array(F.lit("alcohol")).alias("kinds"), text.alias("text"), F.lit(50).alias("new_line"))


def _checked(spark, sf):
    apps = applications(spark, sf)
    sheets = apps.select("label_id", F.lit(1500).alias("page_width"), F.lit(1000).alias("page_height"))
    return plans.check_pages(apps.withColumn("bottler_name_address", F.lit("")), sheets, _page_words(apps), _page_rereads(apps))


PAGES_SQL = f"""
    {APPS_SQL}, l AS (
        SELECT *, CASE defect WHEN 'case' THEN upper(brand_name) WHEN 'letter' THEN 'z' || substr(brand_name, 2) ELSE brand_name END AS brand_line,
            CASE WHEN defect = 'no_alcohol' THEN 'bottled with care' ELSE 'ALC. ' || CASE WHEN defect = 'abv' THEN abv + 5 ELSE abv END || '% BY VOL. (' || CASE defect WHEN 'proof' THEN 2 * abv + 10 WHEN 'abv' THEN 2 * (abv + 5) ELSE 2 * abv END || ' PROOF)' END AS alcohol_line,
            CASE WHEN defect = 'abv' AND label_id % 3 = 0 THEN 'ALC. ' || abv || '% BY VOL. (' || 2 * abv || ' PROOF)' END AS closer_line,
            'NET ' || CASE defect WHEN 'volume' THEN other_net WHEN 'lost_point' THEN replace(net_contents, '.', '') ELSE net_contents END AS net_line,
            CASE label_id % 5 WHEN 0 THEN '{QUOTED}' WHEN 1 THEN '{QUOTED.replace("not drink", "drink", 1)}' WHEN 2 THEN '{QUOTED.replace("women", "wornen", 1)}' WHEN 3 THEN '{QUOTED.replace("GOVERNMENT WARNING:", "Government Warning:", 1)}' END AS statement,
            CASE WHEN label_id % 7 = 0 THEN 50 ELSE 95 END AS conf
        FROM apps
    ), read AS (
        SELECT *, TRY_CAST(regexp_extract(alcohol_line, '([0-9]+)% BY VOL', 1) AS INT) AS a, TRY_CAST(regexp_extract(alcohol_line, '([0-9]+) PROOF', 1) AS INT) AS p,
            TRY_CAST(regexp_extract(closer_line, '([0-9]+)% BY VOL', 1) AS INT) AS ca, TRY_CAST(regexp_extract(closer_line, '([0-9]+) PROOF', 1) AS INT) AS cp,
            CAST(regexp_extract(net_line, '([0-9.]+) m?L$', 1) AS DOUBLE) * CASE WHEN net_line LIKE '% L' THEN 1000 ELSE 1 END AS v, regexp_extract(net_contents, '[0-9.]+') AS digits, regexp_extract(net_line, '[0-9.]+') AS net_digits
        FROM l
    ), fields AS (
        SELECT *,
            CASE WHEN brand_line = brand_name THEN 'MATCH' WHEN lower(brand_line) = lower(brand_name) OR levenshtein(lower(brand_line), lower(brand_name)) = 1 THEN 'NEAR MATCH' ELSE 'MISMATCH' END AS brand,
            CASE WHEN list_contains(string_split(brand_line, ' '), class_type) THEN 'NEAR MATCH' ELSE 'MATCH' END AS class,
            CASE WHEN a IS NULL THEN 'NOT FOUND'
                WHEN ca = abv AND a <> abv THEN CASE WHEN levenshtein(ca || '' || cp, a || '' || p) <= 1 THEN 'MATCH' ELSE 'NEAR MATCH' END
                WHEN a <> abv OR p <> 2 * abv THEN 'MISMATCH' ELSE 'MATCH' END AS alcohol,
            CASE WHEN v = ml THEN 'MATCH' WHEN replace(digits, '.', '') = net_digits AND (net_contents LIKE '% L') = (net_line LIKE '% L') THEN 'NEAR MATCH' ELSE 'MISMATCH' END AS volume,
            CASE WHEN statement IS NULL THEN 'FAIL'
                WHEN statement NOT LIKE 'GOVERNMENT WARNING:%' THEN 'FAIL'
                WHEN statement LIKE '%should drink%' AND conf >= 70 THEN 'FAIL'
                WHEN lower(statement) <> lower('{QUOTED}') OR label_id % 11 = 0 THEN 'REVIEW' ELSE 'PASS' END AS warning
        FROM read
    ), judged AS (
        SELECT *, conf >= 90 AS well, alcohol = 'MISMATCH' OR volume = 'MISMATCH' OR (conf >= 90 AND 'NOT FOUND' IN (alcohol, volume)) OR (conf >= 90 AND brand = 'MISMATCH') OR (warning = 'FAIL' AND conf >= 90) AS fails FROM fields
    )"""


@query(f"""
    WITH {PAGES_SQL}, pins AS (
        SELECT label_id, unnest(['brand_name', 'class_type', 'alcohol_content', 'net_contents', 'bottler_name_address', 'country_of_origin']) AS key, unnest([brand, class, alcohol, volume, 'SKIPPED', 'MATCH']) AS verdict,
            unnest([1, 2, 3, 4, 5, 6]) AS ord, conf FROM judged
    ), boxes AS (
        SELECT *, verdict NOT IN ('NOT FOUND', 'SKIPPED') AND key <> 'alcohol_content' AS boxed FROM pins  -- BY VOL. is one phrase in loose form, and no run of words
    ), shown AS (
        SELECT label_id, ord, key || ' ' || verdict || coalesce(' pin ' || CASE WHEN boxed THEN sum(boxed::INT) OVER (PARTITION BY label_id ORDER BY ord) END, '')
            || coalesce(' clear ' || CASE WHEN verdict = 'MISMATCH' THEN true WHEN verdict = 'NOT FOUND' THEN conf >= 90 END, '') AS field FROM boxes
    ), f AS (SELECT label_id, string_agg(field, '; ' ORDER BY ord) AS fields FROM shown GROUP BY label_id)
    SELECT label_id, warning, CASE WHEN fails THEN 'FAIL' WHEN warning <> 'PASS' OR brand <> 'MATCH' OR class <> 'MATCH' OR alcohol <> 'MATCH' OR volume <> 'MATCH' THEN 'REVIEW' ELSE 'PASS' END AS overall, false AS unreadable, fields FROM judged JOIN f USING (label_id)""")
def verify_pages(spark, sf):
    """Labels from their words: the statement, each field with its verdict, pin and clearness, and the status. (API1, MT12, WR18, EV2-EV7, EV10, EV12)"""
    checked = _checked(spark, sf)
    field = F.concat_ws(" ", "key", "result.verdict", F.concat(F.lit("pin "), F.col("pin").cast("string")), F.concat(F.lit("clear "), F.col("clear").cast("string")))
    fields = checked.fields.select("label_id", F.array_position(F.array(*[F.lit(k) for k in FIELD_KEYS]), F.col("key")).alias("ord"), field.alias("field"))
    fields = fields.groupBy("label_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"]), "; ").alias("fields"))
    return checked.labels.join(shuffled(fields), "label_id").select("label_id", "warning", "overall", "unreadable", "fields")


# Statements (WR1-WR8, SF17, PR11)


def _dropped(k):
    """Which word of the statement a page lacks: none on a quarter of the pages."""
    return F.when(k % 4 != 0, 5 + k % 40)


STATEMENTS_SQL = f"""
    pages AS (SELECT c_custkey AS label_id, c_name, CASE WHEN c_custkey % 4 <> 0 THEN 6 + c_custkey % 40 END AS gone, string_split('{QUOTED}', ' ') AS w FROM customer),
    texts AS (SELECT label_id, list_filter(w, lambda x, i: gone IS NULL OR i <> gone) AS w FROM pages),
    whole AS (SELECT label_id, w, array_to_string(w, ' ') AS t FROM texts),
    p AS (SELECT DISTINCT trim(regexp_replace(lower('{QUOTED}'), '[^a-z0-9 ]', '', 'g')) AS a, trim(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g')) AS b, t FROM whole),
    scores AS (SELECT t, CAST(round_even(200.0 * {LCS_SQL} / (length(a) + length(b)), 0) AS INTEGER) AS score FROM p)"""


@query(f"""
    WITH {STATEMENTS_SQL}
    SELECT label_id, CASE WHEN label_id % 3 = 0 THEN 'turned' ELSE 'upright' END AS frame, sha256(t) AS found, score, array_to_string(w[:5 + label_id % 4], ' ') AS heading,
        CASE WHEN label_id % 5 = 0 THEN 'ATTENTION TAPPING' ELSE '' END AS beside
    FROM whole JOIN scores USING (t)""")
def statement_search(spark, sf):
    """A page a customer: the mandated text, mostly with a word left out, in lines of five to eight words; among other lines, some words beside it, a second reading of
    a line at the same place, and a second frame that was read worse. (WR1-WR8, FZ6, FZ8, SO6, SO7)"""
    k = F.col("c_custkey")
    text = F.filter(F.array(*[F.lit(w) for w in WORDS]), lambda w, i: _dropped(k).isNull() | (i != _dropped(k)))
    pages = dealt(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select(k.cast("long").alias("label_id"), "c_name", text.alias("w"), (5 + k % 4).cast("int").alias("n"))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.col("n")).cast("int")), lambda i: F.array_join(F.slice("w", i * F.col("n") + 1, F.col("n")), " "))
    rows = F.transform(rows, lambda x, i: F.when((i == 3) & (F.col("label_id") % 5 == 0), F.concat(x, F.lit(" ATTENTION TAPPING"))).otherwise(x))
    between = F.when(F.col("label_id") % 2 == 0, F.array(F.lit("for sale only in ohio"))).otherwise(F.array().cast("array<string>"))
    pages = pages.select("label_id", F.concat(F.array("c_name", F.lit("bottled at the source")), F.slice(rows, F.lit(1), F.lit(2)), between, F.slice(rows, F.lit(3), F.lit(99)), F.array(F.lit("750 mL"))).alias("rows"))
    bad = lambda frame: (F.col("label_id") % 3 == 0) == F.lit(frame == "upright")
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), F.when(bad(f), F.transform("rows", lambda x: F.replace(x, F.lit("e"), F.lit("c")))).otherwise(F.col("rows")).alias("rows")) for f in ("turned", "upright")])
    lines_ = pages.select("label_id", F.explode(frames).alias("f")).select("label_id", "f.frame", F.posexplode("f.rows").alias("line_no", "text"))
    box = {"left": F.lit(0), "top": 30 * F.col("line_no"), "width": F.lit(600), "height": F.lit(20), "conf": F.lit(90.0)}
    first = lines_.withColumns(box)
    again = first.where("line_no = 3").withColumns({"line_no": F.lit(100), "text": F.replace("text", F.lit("o"), F.lit("0")), "top": F.col("top") + 2, "left": F.lit(4), "conf": F.lit(50.0)})
    found = passage.check_wording(statement.assemble(first.unionByName(again)))
    return found.select("label_id", "frame", F.sha2("found_text", 256).alias("found"), "score", F.col("heading_text").alias("heading"), "beside")


#: [^A-Za-z]+, which as a negated class takes seven times as long.
NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x{10FFFF}]+"


@query(r"""
    WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM t),
    known AS (SELECT DISTINCT lower(x) AS x FROM words WHERE length(x) % 3 <> 0),
    cut AS (SELECT doc_id, i // 4 AS line, i, words.x, i % 4 = 3 AND i < n - 1 AND length(words.x) >= 4 AS halved, known.x IS NOT NULL AS whole FROM words LEFT JOIN known ON known.x = lower(words.x)),
    parts AS (
        SELECT doc_id, line, i, CASE WHEN halved AND NOT whole THEN substr(x, 1, length(x) // 2) || '-' ELSE x END AS s, halved AND whole AS joined FROM cut
        UNION ALL SELECT doc_id, line + 1, i, substr(x, length(x) // 2 + 1), false FROM cut WHERE halved AND NOT whole
    ), l AS (SELECT doc_id, line, string_agg(s, ' ' ORDER BY i) AS s, sum(joined::INT) AS joined FROM parts GROUP BY doc_id, line)
    SELECT doc_id, sha256(string_agg(s, chr(10) ORDER BY line)) AS found, CAST(sum(joined) AS BIGINT) AS joined FROM l GROUP BY doc_id""")
def hyphens_rejoined(spark, sf):
    """Documents in lines of four words, of which the last is cut by a hyphen; words whose length is a multiple of three aren't in the vocabulary. (SF17)"""
    docs = table(spark, sf, "documents").select("doc_id", F.split(F.nullif(F.trim(F.regexp_replace("text", NO_LETTERS, " ")), F.lit("")), " ").alias("w"))
    vocabulary = docs.select(F.explode_outer("w").alias("x")).where("length(x) % 3 <> 0").select(F.lower("x").alias("word")).distinct()
    half = lambda x: F.floor(F.length(x) / 2).cast("int")

    def line(i):
        """A line from its own four words and the one before them, in the document's row, so nothing is shuffled for it."""
        before, end = F.get("w", 4 * i - 1), F.get("w", 4 * i + 3)
        rest = F.when(F.length(before) >= 4, F.substring(before, half(before) + 1, F.length(before)))
        cut = F.when((4 * i + 4 < F.size("w")) & (F.length(end) >= 4), F.concat(F.left(end, half(end)), F.lit("-"))).otherwise(end)
        return F.concat_ws(" ", rest, F.slice("w", 4 * i + 1, 3), cut)

    made = F.when(F.col("w").isNotNull(), F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 4).cast("int")), line))
    rows = docs.select("doc_id", F.posexplode_outer(made).alias("line_no", "text")).where("line_no is not null")
    found = statement.rejoin_hyphenated(rows.withColumn("hyphen", F.col("text").endswith("-")), shuffled(vocabulary), "doc_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"]), "\n")
    return found.groupBy("doc_id").agg(F.sha2(text, 256).alias("found"), F.count_if(F.col("hyphen") & ~F.col("text").endswith("-")).alias("joined"))


@query(rf"""
    WITH k AS (SELECT p_partkey AS label_id, p_partkey % 4 AS n, (p_partkey // 4) % 4 AS m, p_partkey % 6 AS spot, CASE WHEN p_partkey % 5 = 0 THEN '8' ELSE 'X' END AS e, p_partkey % 7 = 0 AS alike, p_partkey % 3 AS form FROM part),
    t AS (SELECT *, substr('GOVERNMENT', 1, spot::INT) || repeat(e, n::INT) || substr('GOVERNMENT', (spot + n + 1)::INT) AS g0, substr('WARNING', 1, (spot % 3)::INT) || repeat(e, m::INT) || substr('WARNING', (spot % 3 + m + 1)::INT) AS w0 FROM k),
    h AS (SELECT *, CASE WHEN alike THEN replace(g0, 'O', '0') ELSE g0 END AS g, CASE WHEN alike THEN replace(w0, 'I', '|') ELSE w0 END AS v FROM t),
    p AS (SELECT *, 'government warning' AS a, translate(lower(g), '01|l', 'oiii') || ' ' || translate(lower(v), '01|l', 'oiii') AS b FROM h),
    s AS (SELECT *, 200.0 * {LCS_SQL} / (length(a) + length(b)) AS score, levenshtein(split_part(b, ' ', 1), 'government') AS dg, levenshtein(split_part(b, ' ', 2), 'warning') AS dw FROM p)
    SELECT label_id, CASE
        WHEN upper(g) = 'GOVERNMENT' AND v = 'WARNING' THEN CASE form WHEN 0 THEN 'capitals' WHEN 1 THEN 'no_colon' ELSE 'not_capitals' END
        WHEN (dg <= 2 OR (length(split_part(b, ' ', 1)) >= 6 AND contains('government', split_part(b, ' ', 1)))) AND dw <= 2 AND round_even(score, 0) >= 80 THEN CASE WHEN form = 2 AND regexp_matches(lower(g), '[a-km-np-z]') AND regexp_replace(lower(g), '[^a-z]', '', 'g') <> '' THEN 'not_capitals' ELSE 'letter_unclear' END
        WHEN v = 'WARNING' AND form <> 1 THEN CASE WHEN regexp_matches(g, '^[A-Za-z]+$') THEN 'other_word' ELSE 'first_word_unclear' END
        ELSE 'not_found' END AS code FROM s""")
def misread_headings(spark, sf):
    """Headings with up to three wrong letters in each word, some with look-alikes, without a colon or with the first word in lower case. (PR11, SF18, WR14)"""
    k = F.col("p_partkey")
    n, m, at = (k % 4).cast("int"), (F.floor(k / 4) % 4).cast("int"), (k % 6).cast("int")
    e = F.when(k % 5 == 0, "8").otherwise("X")
    cut = lambda word, i, c: F.concat(F.left(F.lit(word), i), F.repeat(e, c), F.substring(F.lit(word), i + c + 1, F.lit(99)))
    g, w = cut("GOVERNMENT", at, n), cut("WARNING", at % 3, m)
    g, w = F.when(k % 7 == 0, F.replace(g, F.lit("O"), F.lit("0"))).otherwise(g), F.when(k % 7 == 0, F.replace(w, F.lit("I"), F.lit("|"))).otherwise(w)
    text = F.when(k % 3 == 0, F.concat(g, F.lit(" "), w, F.lit(": (1)"))).when(k % 3 == 1, F.concat(g, F.lit(" "), w, F.lit(" (1)"))).otherwise(F.concat(F.lower(g), F.lit(" "), w, F.lit(": (1)")))
    rows = table(spark, sf, "part").select(k.alias("label_id"), text.alias("heading_text"))
    return passage.check_headings(rows).select("label_id", F.col("caps_code").alias("code"))


# Evidence (EV9, EV10, JN8, AG18)

TOKENS_SQL = r"""
    l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^A-Za-z\n]+', ' ', 'g'), chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    w AS (SELECT doc_id, line, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS w FROM l),
    tokens AS (SELECT doc_id, line, i - 1 AS word_no, x, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) AS pos FROM (SELECT doc_id, line, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w)),
    ahead AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(line, 2) OVER o AS line2, lead(line, 3) OVER o AS line3 FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"""


#: [^A-Za-z\n]+, which as a negated class takes seven times as long.
OTHER = r"[\x00-\x09\x0B-\x40\x5B-\x60\x7B-\x{10FFFF}]+"


def _read_lines(spark, sf):
    """Documents as lines of letters and blanks, and their words. The lines are read many times, so they are made and written once."""
    text = F.regexp_replace("text", OTHER, " ")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("label_id"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "text")).where("trim(text) <> ''")
    rows = checkpointed(rows)
    return rows, lines.line_words(rows)


@query(f"""
    WITH {TOKENS_SQL},
    own AS (SELECT doc_id, line, len(w) AS n FROM w WHERE len(w) >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line DESC) = 1),
    inside AS (SELECT a.* FROM ahead a JOIN own o ON o.doc_id = a.doc_id AND o.line = a.line WHERE word_no = 2),
    across AS (SELECT a.* FROM ahead a JOIN (SELECT doc_id, line, len(w) AS n FROM w) s ON s.doc_id = a.doc_id AND s.line = a.line WHERE word_no = n - 2 AND line3 = a.line + 1 QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY a.line) = 1),
    found AS (
        SELECT a.doc_id, 'inside' AS key, a.line AS first_line, a.word_no AS first_word, 3 AS n FROM ahead a JOIN inside i ON a.doc_id = i.doc_id AND a.line = i.line AND a.x = i.x AND a.x1 = i.x1 AND a.x2 = i.x2 AND a.line2 = i.line
            QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY a.pos) = 1
        UNION ALL SELECT a.doc_id, 'across', a.line, a.word_no, 4 FROM ahead a JOIN across i ON a.doc_id = i.doc_id AND a.x = i.x AND a.x1 = i.x1 AND a.x2 = i.x2 AND a.x3 = i.x3 AND a.line3 - a.line <= 1
            QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY a.line3 - a.line, a.pos) = 1
        UNION ALL SELECT doc_id, 'absent', line, 0, n FROM own
    ) SELECT doc_id AS label_id, key, CAST(first_line AS INT) AS first_line, CAST(first_word AS INT) AS first_word, CAST(n AS BIGINT) AS n, key <> 'absent' AS exact FROM found""")
def evidence_words(spark, sf):
    """Texts cut from a document's own lines, inside a line and across two, and one that isn't there: the words that spell them. (EV9, JN8, AR4)"""
    rows, words = _read_lines(spark, sf)
    w = rows.select("label_id", "line_no", F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("w"))
    own = w.where("size(w) >= 5").groupBy("label_id").agg(F.max_by("w", "line_no").alias("w"), F.max("line_no").alias("line_no"))
    on = lambda key, text: own.select("label_id", F.lit(key).alias("key"), text.alias("text"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))
    ends = w.where("size(w) >= 2")
    next_line = ends.select("label_id", (F.col("line_no") - 1).alias("line_no"), F.slice("w", 1, 2).alias("next"))
    across = ends.select("label_id", "line_no", F.slice("w", -2, 2).alias("w")).join(shuffled(next_line), ["label_id", "line_no"]).groupBy("label_id").agg(F.min_by(F.concat("w", "next"), "line_no").alias("t"))
    across = across.select("label_id", F.lit("across").alias("key"), F.array_join("t", " ").alias("text"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    wanted = on("inside", F.array_join(F.slice("w", 3, 3), " ")).unionByName(on("absent", F.lit("qqzzqq there"))).unionByName(across).withColumn("part", F.lit(0))
    found = traced.run_words(words, wanted)
    first = F.min(F.struct("line_no", "word_no"))
    return found.groupBy("label_id", "key").agg(first.alias("f"), F.count("*").alias("n"), F.bool_and("exact").alias("exact")).select("label_id", "key", F.col("f.line_no").alias("first_line"), F.col("f.word_no").alias("first_word"), "n", "exact")


@query(f"""
    WITH {BOXES_SQL}, words AS (SELECT l_suppkey AS label_id, l_orderkey AS line_no, "left" + l_linenumber * 37 AS "left", top * 3 AS top, width, height, CAST(l_discount * 1000 AS INT) AS conf FROM lineitem JOIN boxes ON l_orderkey = label_id AND l_linenumber = line_no),
    box AS (SELECT label_id, min("left") AS x0, min(top) AS y0, max("left" + width) AS x1, max(top + height) AS y1 FROM words WHERE line_no % 100 = label_id % 100 GROUP BY label_id)
    SELECT label_id, round_even(avg(conf), 1) AS conf FROM words JOIN box USING (label_id) WHERE "left" + width / 2.0 BETWEEN x0 AND x1 AND top + height / 2.0 BETWEEN y0 AND y1 GROUP BY label_id""")
def box_confidence(spark, sf):
    """The lines of a supplier as one large page: the confidence inside the box around some of them. (AG18)"""
    own = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("label_id"), F.col("l_linenumber").alias("line_no"), F.round(F.col("l_discount") * 1000).cast("int").alias("conf"))
    words = own.join(_boxes(spark, sf), ["label_id", "line_no"]).select(F.col("page").alias("label_id"), F.col("label_id").alias("line_no"), F.lit("word").alias("text"), (F.col("left") + 37 * F.col("line_no")).alias("left"), (3 * F.col("top")).alias("top"), "width", "height", "conf")
    box = words.where("line_no % 100 = label_id % 100").groupBy("label_id").agg(plans.geometry.union_box("left", "top", "width", "height").alias("b")).select("label_id", "b.*")
    return traced.box_confidence(words, box)


# Closer readings (EV16, ST5, MT9, MT10)


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), d AS (SELECT doc_id, i, t FROM l WHERE trim(t, ' ') <> ''),
    k AS (SELECT doc_id, i, t, unnest(['alcohol', 'volume']) AS kind FROM d)
    SELECT doc_id AS label_id, kind, sha256(string_agg(t, chr(10) ORDER BY i)) AS found FROM k WHERE i % 5 <> 1 OR i % 3 = 0 OR (i % 3 = 1) = (kind = 'alcohol') GROUP BY doc_id, kind""")
def figure_texts(spark, sf):
    """Every fifth line of a document is a crop that was read for the alcohol content, the net contents or both. (EV16, ST5)"""
    rows = lines.document_lines(table(spark, sf, "documents"))
    kinds = F.when(F.col("line_no") % 3 == 0, F.array(F.lit("alcohol"), F.lit("volume"))).when(F.col("line_no") % 3 == 1, F.array(F.lit("alcohol"))).otherwise(F.array(F.lit("volume")))
    crops = rows.where("line_no % 5 = 1").select("label_id", F.lit(0).alias("seq"), F.col("line_no") - 1, kinds.alias("kinds"), "text", F.col("line_no").alias("new_line"))
    each = [rereads.figure_text(rows, crops, kind).select("label_id", F.lit(kind).alias("kind"), F.sha2("label_text", 256).alias("found")) for kind in ("alcohol", "volume")]
    return each[0].unionByName(each[1])


@query(f"""
    WITH {APPS_SQL}, r AS (SELECT label_id, abv, label_id % 6 AS c, CASE label_id % 6 WHEN 4 THEN abv + 11 WHEN 0 THEN abv ELSE abv + 1 END AS page FROM apps),
    s AS (SELECT *, CASE c WHEN 5 THEN [] WHEN 1 THEN [abv, abv + 7] ELSE [abv] END AS closer FROM r),
    j AS (SELECT *, page <> abv AND list_contains(closer, abv) AND len(list_filter(closer, lambda x: x <> abv)) = 0 AND levenshtein(page || '', abv || '') <= 1 AS settled FROM s)
    SELECT label_id, CASE WHEN page = abv OR settled THEN 'MATCH' WHEN len(closer) = 0 THEN 'MISMATCH' ELSE 'NEAR MATCH' END AS verdict,
        CASE WHEN settled THEN 'confirmed' WHEN page = abv AND len(closer) > 0 THEN 'second_read_same' WHEN page <> abv AND list_contains(closer, abv) THEN '' ELSE '' END AS notes FROM j""")
def settled_figures(spark, sf):
    """Alcohol lines read again: the same, one digit off, two digits off, with closer readings that agree, contradict each other, or are missing. (MT9, MT10)"""
    apps = applications(spark, sf)
    c, abv = F.col("label_id") % 6, F.col("abv")
    said = lambda x: F.concat(F.lit("ALC. "), x.cast("string"), F.lit("% BY VOL."))
    page = F.when(c == 4, abv + 11).when(c == 0, abv).otherwise(abv + 1)
    seconds = F.when(c == 5, F.array().cast("array<bigint>")).when(c == 1, F.array(abv, abv + 7).cast("array<bigint>")).otherwise(F.array(abv).cast("array<bigint>"))
    crops = apps.select("label_id", F.posexplode(seconds).alias("seq", "x")).select("label_id", "seq", F.lit(0).alias("line_no"), F.array(F.lit("alcohol")).alias("kinds"), said(F.col("x")).alias("text"), (F.col("seq") + 1).alias("new_line"))
    rows = apps.select("label_id", F.lit(0).alias("line_no"), said(page).alias("text")).unionByName(crops.select("label_id", F.col("new_line").alias("line_no"), "text"))
    found = plans._figure_field(apps.withColumn("alcohol_content", said(abv)), rows, crops, "alcohol", plans.THRESHOLDS)
    return found.select("label_id", F.col("result.verdict").alias("verdict"), F.array_join("notes", ", ").alias("notes"))


# Generated applications (GEN2-GEN4)


def _drawn(what: str, options, weights=None) -> str:
    """The same draw in SQL."""
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (5 - i)}" for i in range(6))
    weights = weights or [1] * len(options)
    upto = [sum(weights[: i + 1]) for i in range(len(weights))]
    cases = " ".join(f"WHEN x < {-(-u * generate.WHOLE // upto[-1])} THEN {o!r}" for o, u in zip(options[:-1], upto))
    return f"(SELECT CASE {cases} ELSE {options[-1]!r} END FROM (SELECT {digits} AS x FROM (SELECT md5('{what}:' || p_partkey) AS h)))"


def _by_category(place: int, what: str) -> str:
    return "CASE category " + " ".join(f"WHEN {c!r} THEN {_drawn(what, lists[place])}" for c, lists in generate.KINDS.items()) + " END"


GENERATED_SQL = f"""
    c AS (SELECT p_partkey, {_drawn("category", [c for c, _ in generate.CATEGORIES], [w for _, w in generate.CATEGORIES])} AS category, {_drawn("defect", [d for d, _ in generate.DEFECTS], [w for _, w in generate.DEFECTS])} AS defect FROM part),
    g AS (SELECT *, {_drawn("first", generate.FIRST)} || ' ' || {_drawn("second", generate.SECOND)} AS brand_name, {_by_category(0, "class")} AS class_type, CAST({_by_category(1, "abv")} AS DOUBLE) AS abv, {_by_category(2, "volume")} AS net_contents FROM c),
    l AS (SELECT *, CASE WHEN defect = 'wrong_abv' THEN abv + CASE WHEN abv > 20 THEN 5 ELSE 1.5 END ELSE abv END AS label_abv,
        CASE defect WHEN 'wrong_net_contents' THEN CASE net_contents WHEN '1 L' THEN '750 mL' ELSE '1 L' END WHEN 'missing_net_contents' THEN NULL ELSE net_contents END AS label_volume FROM g)"""


@query(f"WITH {GENERATED_SQL} SELECT p_partkey AS label_id, category, defect, brand_name, class_type, abv, net_contents, label_abv, label_volume FROM l")
def generated_applications(spark, sf):
    """(GEN2, GEN3, GEN4)"""
    rows = generate.applications(table(spark, sf, "part").select(F.col("p_partkey").alias("label_id")))
    return rows.select("label_id", "category", "defect", "brand_name", "class_type", "abv", "net_contents", "label_abv", "label_volume")


@query(f"WITH {GENERATED_SQL} SELECT defect, CASE WHEN label_abv <> abv OR label_volume IS DISTINCT FROM net_contents THEN 'FAIL' WHEN defect = 'brand_case' THEN 'REVIEW' ELSE 'PASS' END AS overall, true AS as_expected, count(*) AS labels FROM l GROUP BY ALL")
def generated_verified(spark, sf):
    """Every planted figure is caught, and nothing else. (GEN4, AG9)"""
    rows = generate.applications(dealt(table(spark, sf, "part").select(F.col("p_partkey").alias("label_id")), "label_id"))
    found = verify.verify(rows, generate.label_lines(rows)).join(shuffled(rows.select("label_id", "defect", "expected")), "label_id")
    return found.groupBy("defect", "overall", (F.col("overall") == F.col("expected")).alias("as_expected")).agg(F.count("*").alias("labels"))


# Answers (EV14, JS3, API3)


@query("""
    WITH a AS (
        SELECT user_id AS application_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'click' THEN 'fail' WHEN 'view' THEN 'skip' WHEN 'error' THEN 'clear' ELSE event_type END AS decision,
            ['brand_name', 'class_type', 'alcohol_content', 'net_contents', ''][CAST(json_extract(props, '$.k') AS INT) % 5 + 1] AS key,
            [[], ['brand_name', 'net_contents'], ['brand_name', 'class_type', 'alcohol_content']][user_id % 3 + 1] AS qs FROM events
    ), c AS (SELECT *, CASE WHEN decision NOT IN ('pass', 'fail', 'skip', 'clear') THEN 'decision' WHEN key <> '' AND NOT list_contains(qs, key) THEN 'question' ELSE '' END AS error FROM a
    ), e AS (SELECT application_id, seq, key, decision, unnest(CASE WHEN len(qs) = 0 THEN [''] ELSE qs END) AS q FROM c WHERE error = ''
    ), s AS (SELECT application_id, seq, last_value(CASE WHEN key = '' OR key = q THEN decision END IGNORE NULLS) OVER (PARTITION BY application_id, q ORDER BY seq) AS v FROM e
    ), d AS (SELECT application_id, seq, CASE WHEN bool_or(coalesce(v, '') = 'fail') THEN 'fail' WHEN bool_or(coalesce(v, 'clear') = 'clear') THEN 'partial' WHEN bool_and(coalesce(v, '') = 'pass') THEN 'pass' ELSE 'skip' END AS label_decision FROM s GROUP BY ALL)
    SELECT seq, error, label_decision, CASE WHEN error = '' THEN coalesce(nullif(key, ''), qs[1]) END AS asked FROM c LEFT JOIN d USING (application_id, seq)""")
def decision_records(spark, sf):
    """Events as answers, some of another kind or to questions that their label hasn't; what is recorded of the sound ones. (EV14, JS3, API3, MP1)"""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.create_map(*[F.lit(x) for x in ("purchase", "pass", "click", "fail", "view", "skip", "error", "clear")])
    events = table(spark, sf, "events")
    requests = events.select(F.lit("j").alias("job"), F.col("user_id").alias("application_id"), F.element_at(F.array(*[F.lit(x) for x in ("brand_name", "class_type", "alcohol_content", "net_contents", "")]), (k % 5 + 1).cast("int")).alias("key"), F.coalesce(kinds[F.col("event_type")], F.col("event_type")).alias("decision"), F.col("event_id").alias("seq"))
    questions = F.when(F.col("user_id") % 3 == 1, F.array(F.lit("brand_name"), F.lit("net_contents"))).when(F.col("user_id") % 3 == 2, F.array(F.lit("brand_name"), F.lit("class_type"), F.lit("alcohol_content"))).otherwise(F.array().cast("array<string>"))
    prompts = F.transform(questions, lambda q: F.struct(q.alias("key"), F.lit("NEAR MATCH").alias("verdict"), F.lit("?").alias("question"), F.lit(False).alias("asked")))
    labels = events.select("user_id").distinct().select(F.lit("j").alias("job"), F.col("user_id").alias("application_id"), prompts.alias("prompts"), F.lit("REVIEW").alias("overall"))
    checked = review.checked_answers(requests, labels)
    error = F.when(F.col("error").startswith("decision"), "decision").when(F.col("error").startswith("this label"), "question").when(F.col("error").isNull(), "").otherwise("label")
    lines_ = review.decision_records(requests, labels).select("seq", F.get_json_object("line", "$.label_decision").alias("label_decision"), F.get_json_object("line", "$.asked").alias("asked"))
    return checked.select("seq", error.alias("error")).join(lines_, "seq", "left").select("seq", "error", "label_decision", "asked")


# Smaller parts of pages, readings and the registry


@query("""
    SELECT l_suppkey AS label_id, l_returnflag AS frame, l_linenumber AS line_no, median(CAST(l_partkey % 40 AS INT) * 5) AS top, median(CAST(l_partkey % 40 AS INT) * 5 + 20 + CAST(l_orderkey % 7 AS INT)) AS bottom,
        min(CAST(l_quantity AS INT) * 10) AS "left", max(CAST(l_quantity AS INT) * 10 + CAST(l_orderkey % 9 AS INT)) AS "right", median(20 + CAST(l_orderkey % 7 AS INT)) AS height FROM lineitem GROUP BY ALL""")
def line_geometry(spark, sf):
    """(AG26)"""
    words = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("label_id"), F.col("l_returnflag").alias("frame"), F.col("l_linenumber").alias("line_no"), ((F.col("l_partkey") % 40).cast("int") * 5).alias("top"),
        (F.col("l_quantity").cast("int") * 10).alias("left"), (F.col("l_orderkey") % 9).cast("int").alias("width"), (20 + (F.col("l_orderkey") % 7).cast("int")).alias("height"))
    return plans.geometry.line_geometry(words, "label_id", "frame", "line_no")


@query("""
    SELECT p_size % 2 = 0 AS bold, p_brand AS family, CAST(p_size % 3 AS INT) AS blur, count(*) AS n, round(min(r), 9) AS least, round(median(r), 9) AS middle, round(max(r), 9) AS largest
    FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE CAST(p_size * 3 AS DOUBLE) / (p_partkey % 7 + 5) END AS r FROM part) GROUP BY ALL""")
def weight_ranges(spark, sf):
    """(AG12)"""
    ratio = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") * F.lit(3.0) / (F.col("p_partkey") % 7 + 5))
    rows = table(spark, sf, "part").select((F.col("p_size") % 2 == 0).alias("bold"), F.col("p_brand").alias("family"), (F.col("p_size") % 3).cast("int").alias("blur"), ratio.alias("ratio"))
    return plans.geometry.weight_ranges(rows, "bold", "family", "blur").withColumns({c: F.round(c, 9) for c in ("least", "middle", "largest")})


@query("SELECT l_orderkey AS label_id, CAST(l_linenumber - 1 AS INT) AS view, l_linenumber IN (1, 5, 6, 7) OR (l_orderkey + l_linenumber - 1) % 4 = 0 AS is_upright FROM lineitem")
def read_upright(spark, sf):
    """Views 1 to 3 are turned by quarters, page by page; views from 4 on are unknown. (FLT13)"""
    words = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("label_id"), (F.col("l_linenumber") - 1).cast("int").alias("view"))
    views = table(spark, sf, "orders").select(F.col("o_orderkey").alias("label_id"), F.explode(F.array(*map(F.lit, range(4)))).alias("view"))
    views = views.withColumn("rotation", F.when(F.col("view") == 0, 90).otherwise(90 * ((F.col("label_id") + F.col("view")) % 4)))
    return traced.read_upright(words, views).select("label_id", "view", "is_upright")


@query(f"""
    WITH {TOKENS_SQL}, c AS (SELECT doc_id, line FROM tokens GROUP BY ALL HAVING sum(least(100, 20 * length(x))) >= 80 * count(*)),
    d AS (SELECT l.doc_id, l.line, l.t FROM l WHERE trim(t, ' ') <> ''), m AS (SELECT doc_id, max(line) AS m FROM d GROUP BY doc_id)
    SELECT doc_id AS label_id, CAST(line AS INT) AS line_no, 0 AS view, length(t) AS size FROM d
    UNION ALL SELECT doc_id, CAST(m + row_number() OVER (PARTITION BY doc_id ORDER BY line) AS INT), 1, length(t) FROM d JOIN c USING (doc_id, line) JOIN m USING (doc_id)""")
def append_view(spark, sf):
    """Each document read twice, the second time surest of long words. (FLT7)"""
    rows, words = _read_lines(spark, sf)
    words = words.withColumn("conf", F.least(F.lit(100), 20 * F.length("text")))
    found = lines.append_view(rows.withColumn("view", F.lit(0)), rows, words, 1, 80)
    return found.select("label_id", "line_no", "view", F.length("text").cast("long").alias("size"))


@query("""
    SELECT l_orderkey AS label_id, array_to_string(list(CAST(l_linenumber AS VARCHAR) ORDER BY coalesce(c = false, false), l_linenumber), ',') AS fields
    FROM (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c FROM lineitem) GROUP BY ALL""")
def clear_problems_first(spark, sf):
    """(SO5)"""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 3 == 0, True).when(F.col("l_suppkey") % 3 == 1, False).alias("clear"))
    problems = rows.groupBy(F.col("l_orderkey").alias("label_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "clear"))).alias("p"))
    return problems.select("label_id", F.array_join(F.transform(evidence.clear_first(F.col("p")), lambda p: p["l_linenumber"].cast("string")), ",").alias("fields"))


@query(r"""
    WITH d AS (SELECT doc_id, string_split_regex(text, '[ \t\n\r]+') AS w FROM documents), e AS (SELECT doc_id, w, len(w) AS n, CAST(doc_id % len(w) AS INT) AS a, CAST(1 + doc_id % 3 AS INT) AS k FROM d)
    SELECT doc_id, CASE WHEN a + k < n THEN array_to_string(w[a + 1 : a + k + 1], ' ') ELSE array_to_string(w[greatest(a - 1, 0) + 1 : a + k], ' ') END AS phrase FROM e""")
def phrases_at(spark, sf):
    """(SF29)"""
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", r"[ \t\n\r]+").alias("w"))
    return docs.select("doc_id", passage.phrase_at(F.col("w"), (F.col("doc_id") % F.size("w")).cast("int"), (1 + F.col("doc_id") % 3).cast("int")).alias("phrase"))


@query("""
    WITH r AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'no' ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE c_custkey % 7 WHEN 0 THEN ' ' ELSE c_name END AS brand,
        CASE c_custkey % 4 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' WHEN 2 THEN 'beer' ELSE 'other' END AS kind, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'new york' ELSE n_name END AS origin FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT id, brand, kind, coalesce(origin, '') AS origin, coalesce(origin, '') <> '' AND upper(origin) NOT IN ('NEW YORK', 'UNITED STATES') AS imported FROM r WHERE id <> 'no' AND trim(brand) <> '' AND kind <> 'other'""")
def registry_rows(spark, sf):
    """(FLT11, SF23)"""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.when(key % 9 == 0, "12-3").otherwise(F.concat(F.lit(" '"), key.cast("string"), F.lit("' "))).alias("id"), F.when(key % 7 == 0, " ").otherwise(F.col("c_name")).alias("brand"),
        F.when(key % 4 == 0, "Straight Whiskey").when(key % 4 == 1, "RED WINE").when(key % 4 == 2, "pale ale").otherwise("ginger water").alias("description"),
        F.when(key % 5 == 0, " ").when(key % 5 == 1, "new york").otherwise(F.col("n_name")).alias("origin"))
    return readers.registry_rows(rows).select("id", "brand", "kind", "origin", "imported")
