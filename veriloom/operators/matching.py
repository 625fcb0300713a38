"""Where an application's values stand on a document, and how they compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import METRIC, ORIGIN_PREFIXES, SEPARATORS, STANDARD_ML, THRESHOLDS, Thresholds
from ..functions import figures, similarity
from ..functions.text import PLAIN_TEXT, country_key, despaced, general_number, is_word, letter_spaced, normalize_loose, normalize_strict, shape_fold, strip_edges, words
from ..sources.shared import shuffled

VERDICT = "struct<verdict:string,score:int,code:string,found:string>"


def verdict(kind: str, score, code: str, found) -> Column:
    return F.struct(F.lit(kind).alias("verdict"), (F.lit(score) if isinstance(score, int) else score).cast("int").alias("score"), F.lit(code).alias("code"), found.cast("string").alias("found"))


def first_of(*rules: tuple[Column, Column]) -> Column:
    """The verdict of the first rule that holds."""
    out = F.lit(None).cast(VERDICT)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


# Locating (MT1, JN5, WN3)

#: Two texts that are not equal have together so many characters at least where their ratio, rounded, is 100: one character short of equal it is 100 - 100 / that.
UNEQUAL_HUNDRED = 199


def first_true(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(None)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def line_tokens(lines: DataFrame) -> DataFrame:
    """Adds raw and loose, the words of a line and their loose forms, to rows (label_id, line_no, text)."""
    plain = F.col("text").rlike(PLAIN_TEXT)
    rows = lines.withColumn("raw", F.when(plain, F.split("text", " ")).otherwise(words(normalize_strict("text"))))
    return rows.withColumn("loose", F.when(plain, F.split(F.lower("text"), " ")).otherwise(F.transform("raw", normalize_loose)))


def line_windows(lines: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """(label_id, line_no, raw0, loose0, raw1, loose1, ...): the tokens of each line and of those that follow it, up to locate_max_lines; null after the last.

    All searches start from these rows, so Spark shuffles the tokens of a plan once.
    """
    tokens = line_tokens(lines).select("label_id", "line_no", F.col("raw").alias("raw0"), F.col("loose").alias("loose0"))
    order = Window.partitionBy("label_id").orderBy("line_no")
    return tokens.select("*", *[F.lead(f"{c}0", k).over(order).alias(f"{c}{k}") for k in range(1, th.locate_max_lines) for c in ("raw", "loose")])


def running_lengths(tokens: Column) -> Column:
    """0, then for each token the characters up to its end, with a blank after each token that is not empty."""
    more = lambda s, x: F.array_append(s, F.element_at(s, -1) + F.when(x == "", 0).otherwise(F.length(x) + 1))
    return F.aggregate(tokens, F.array(F.lit(0)).cast("array<int>"), more)


def spans(values: DataFrame, lines: DataFrame, th: Thresholds = THRESHOLDS, floor: int = 0) -> DataFrame:
    """Candidate spans (label_id, key, expected, ...) of values (label_id, key, expected) over up to locate_max_lines consecutive lines.

    A span has as many words as the value, span_slack more or less; it starts on its first line and ends on its last. Lines
    meet values by an equi-join on label_id; the lines that follow come from lead(), so no label is collected. Spans that cannot be the best go by their
    lengths, before their texts are made: those that cannot reach the floor, and, of a value whose very tokens stand on the label, those whose score cannot be 100.
    """
    upto = range(th.locate_max_lines)
    none = F.array().cast("array<string>")
    every = {c: F.concat(*[F.coalesce(f"{c}{k}", none) for k in upto]) for c in ("raw", "loose")}
    ends = [F.size(F.concat(*[F.coalesce(f"raw{i}", none) for i in range(k + 1)])).alias(f"end{k}") for k in upto]
    tokens = line_windows(lines, th).where("size(raw0) > 0").select("label_id", "line_no", every["raw"].alias("raw"), every["loose"].alias("loose"), *ends, running_lengths(every["loose"]).alias("upto"), F.concat(F.lit("\n"), F.array_join(every["loose"], "\n"), F.lit("\n")).alias("joint"))
    own = words(normalize_strict("expected"))
    wanted = values.select("label_id", "key", "expected", normalize_loose("expected").alias("want"), strip_edges(normalize_strict("expected")).alias("exact"), F.greatest(F.size(own), F.lit(1)).alias("n"), F.transform(own, normalize_loose).alias("own"))
    plain = F.array_join(F.filter("own", lambda x: x != ""), " ") == F.col("want")
    wanted = wanted.withColumn("tokens", F.when(plain, F.concat(F.lit("\n"), F.array_join("own", "\n"), F.lit("\n")))).drop("own")
    rows = wanted.join(shuffled(tokens), "label_id")
    there = F.coalesce(F.contains("joint", "tokens"), F.lit(False))
    rows = rows.withColumn("there", F.max(there).over(Window.partitionBy("label_id", "key", "expected"))).drop("joint", "tokens")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("end0") - 1)).alias("a"))
    rows = rows.select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - th.span_slack), F.col("n") + th.span_slack)).alias("len"))
    rows = rows.where(F.col("a") + F.col("len") <= F.col(f"end{upto[-1]}")).withColumn("chars", F.get("upto", F.col("a") + F.col("len")) - F.get("upto", "a") - 1).where("chars > 0")
    bound, both = similarity.length_bound(F.length("want"), F.col("chars")), F.length("want") + F.col("chars")
    rows = rows.where((F.length("want") > 0) & (bound >= floor - 0.5) & (~F.col("there") | (F.length("want") == F.col("chars")) | ((both >= UNEQUAL_HUNDRED) & (bound >= 99.5))))
    last_line = lambda x: first_true([(F.col("a") + F.col("len") <= F.col(f"end{k}"), x(k)) for k in upto])
    inside, shown = F.slice("loose", F.col("a") + 1, F.col("len")), F.slice("raw", F.col("a") + 1, F.col("len"))
    rows = rows.select(
        "label_id", "key", "expected", "want", "exact", "line_no", (F.col("line_no") + last_line(F.lit)).alias("line_end"), "a", "len", F.array_join(F.filter(inside, lambda x: x != ""), " ").alias("candidate"), shown.alias("shown"),
        F.when(F.col("a") > 0, F.get("raw", F.col("a") - 1)).alias("back"), F.when(F.col("a") + F.col("len") < last_line(lambda k: F.col(f"end{k}")), F.get("raw", F.col("a") + F.col("len"))).alias("ahead"),
    )
    last = lambda x: F.right(x, F.lit(1)).isin(*SEPARATORS)
    first = lambda x: F.left(x, F.lit(1)).isin(*SEPARATORS)
    back, ahead = F.col("back"), F.coalesce("ahead", F.lit(""))
    left = back.isNotNull() & is_word(back) & ~last(back) & ~first(F.get("shown", F.lit(0)))
    right = is_word(ahead) & ~last(F.get("shown", F.col("len") - 1)) & ~first(ahead)
    return rows.select("label_id", "key", "expected", "want", "exact", "line_no", "line_end", "a", "len", "candidate", strip_edges(F.array_join("shown", " ")).alias("text"), (left | right).alias("joined"))


def locate(values: DataFrame, lines: DataFrame, preferred: DataFrame | None = None, floor: int | None = None, th: Thresholds = THRESHOLDS) -> DataFrame:
    """The best span of each value: (label_id, key, expected, text, score, line_start, line_end, joined); values without one are left out.

    Ranked by score, then by standing on the preferred line (label_id, line; with a column key for that value only), then by equal case, then by place. Spans that
    cannot be the best whatever their characters are dropped before the score is computed (see spans), which changes no result.
    """
    floor = th.find_floor if floor is None else floor
    rows = spans(values, lines, th, floor)
    if preferred is not None:
        own = ["label_id", "key"] if "key" in preferred.columns else ["label_id"]
        rows = rows.join(shuffled(preferred.select(*own, F.col("line").alias("_line"))), own, "left")
        chosen = F.coalesce((F.col("line_no") == F.col("_line")) & (F.col("line_end") == F.col("_line")), F.lit(False))
    else:
        chosen = F.lit(False)
    rows = rows.withColumn("score", similarity.ratio("want", "candidate"))
    rank = F.struct("score", chosen.alias("p"), (F.col("text") == F.col("exact")).alias("e"), (-F.col("line_no")).alias("i"), (-F.col("line_end")).alias("j"), (-F.col("a")).alias("a"), (-F.col("len")).alias("n"))
    best = rows.groupBy("label_id", "key", "expected").agg(F.max_by(F.struct("text", "score", F.col("line_no").alias("line_start"), "line_end", "joined"), rank).alias("b"))
    # The best one decides: a filter of all scores would have Spark compute them twice.
    return best.where(F.col("b.score") >= floor).select("label_id", "key", "expected", "b.*")


def locate_letter_spaced(values: DataFrame, lines: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Values set with wide spaces: (label_id, key, text, score, line_start, line_end) of the best run of lines made of single letters. (MT2)"""
    order, upto = Window.partitionBy("label_id").orderBy("line_no"), range(th.locate_max_lines)
    tokens = line_windows(lines, th).withColumn("own", words(F.array_join("loose0", " ")))
    tokens = tokens.withColumns({"n": F.size("own"), "single": F.size(F.filter("own", lambda w: F.length(w) == 1))}).drop("own")
    counts = [F.struct(F.lit(k).alias("more"), *[F.sum(c).over(order.rowsBetween(0, k)).alias(c) for c in ("n", "single")], F.col(f"raw{k}").isNotNull().alias("full")) for k in upto]
    runs = tokens.select("label_id", "line_no", *[F.array(*[F.col(f"{c}{k}") for k in upto]).alias(c) for c in ("raw", "loose")], F.array(*counts).alias("runs"))
    runs = runs.select("label_id", "line_no", "raw", "loose", F.explode("runs").alias("run")).where("run.full and run.n >= 4 and run.single >= 0.6 * run.n")
    text = lambda c: F.flatten(F.slice(c, 1, F.col("run.more") + 1))
    runs = runs.select("label_id", "line_no", F.struct("run.more", F.array_join(text("raw"), " ").alias("raw"), F.array_join(F.filter(text("loose"), lambda x: x != ""), " ").alias("loose")).alias("w"))
    wanted = values.select("label_id", "key", despaced(normalize_loose("expected")).alias("want")).where("length(want) >= 4")
    rows = wanted.join(shuffled(runs), "label_id").withColumn("joined", despaced(F.col("w.loose"))).where("length(joined) <= 1.6 * length(want)")
    rows = rows.withColumn("score", similarity.best_part_ratio("want", "joined"))
    best = F.max_by(F.struct(strip_edges(F.col("w.raw")).alias("text"), "score", F.col("line_no").alias("line_start"), (F.col("line_no") + F.col("w.more")).alias("line_end")), F.struct("score", -F.col("line_no"), -F.col("w.more")))
    return rows.groupBy("label_id", "key").agg(best.alias("b")).select("label_id", "key", "b.*")


def locate_all(values: DataFrame, lines: DataFrame, preferred: DataFrame | None = None, th: Thresholds = THRESHOLDS) -> DataFrame:
    """locate(), or the letter-spaced reading where it is strictly better and the first is no near match."""
    plain = locate(values, lines, preferred, th=th)
    spaced = locate_letter_spaced(values, lines, th).select("label_id", "key", F.struct("text", "score", "line_start", "line_end", F.lit(False).alias("joined")).alias("s"))
    both = values.select("label_id", "key", "expected").join(shuffled(plain.select("label_id", "key", F.struct("text", "score", "line_start", "line_end", "joined").alias("p"))), ["label_id", "key"], "left").join(shuffled(spaced), ["label_id", "key"], "left")
    better = F.col("s.score").isNotNull() & (F.coalesce("p.score", F.lit(-1)) < th.near_match) & (F.col("s.score") > F.coalesce("p.score", F.lit(th.find_floor - 1)))
    return both.select("label_id", "key", "expected", F.when(better, F.col("s")).otherwise(F.col("p")).alias("b")).where("b is not null").select("label_id", "key", "expected", "b.*")


# Text (MT3, MT4, MT6)


def compare_text(key: Column, expected: Column, found: Column, score: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Verdict of a located text. score is similarity.text_score of the loose forms. A likeness alone is never a match."""
    a, b = normalize_loose(expected), normalize_loose(found)
    return first_of(
        (found.isNull(), verdict("NOT FOUND", 0, "not_found", found)),
        (strip_edges(normalize_strict(expected)) == strip_edges(normalize_strict(found)), verdict("MATCH", 100, "exact", found)),
        ((a != b) & letter_spaced(b) & (despaced(a) == despaced(b)), verdict("MATCH", 100, "letter_spaced", found)),
        ((a == b) & key.isin(*th.case_review_fields), verdict("NEAR MATCH", 100, "case_differs", found)),
        (a == b, verdict("MATCH", 100, "loose", found)),
        ((score < th.near_match) & (F.length(a) >= 5) & (F.levenshtein(a, b) == 1), verdict("NEAR MATCH", score, "one_letter", found)),
        (score >= th.near_match, verdict("NEAR MATCH", score, "similar", found)),
        (F.lit(True), verdict("MISMATCH", score, "different", found)),
    )


def blank_or(expected: Column, required: Column, otherwise: Column) -> Column:
    """Blank values are skipped if optional, and not found if required. (MT4)"""
    none = F.lit(None)
    return first_of((F.trim(expected) == "", F.when(required, verdict("NOT FOUND", 0, "required", none)).otherwise(verdict("SKIPPED", 0, "not_given", none))), (F.lit(True), otherwise))


def compare_located(values: DataFrame, lines: DataFrame, preferred: DataFrame | None = None, heights: DataFrame | None = None, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Rows (label_id, key, expected, result, line_start, line_end) for text values (label_id, key, expected, required). (MT6)

    A match inside a longer phrase, or a brand only in small print, becomes a near match.
    """
    found = locate_all(values, lines, preferred, th).select("label_id", "key", F.col("text").alias("found"), "line_start", "line_end", "joined")
    rows = values.join(shuffled(found), ["label_id", "key"], "left").withColumns({"a": normalize_loose("expected"), "b": normalize_loose("found")})
    rows = rows.withColumn("likeness", similarity.text_score("a", "b"))
    result = blank_or(F.col("expected"), F.col("required"), compare_text(F.col("key"), F.col("expected"), F.col("found"), F.col("likeness"), th))
    rows = rows.withColumn("result", result)
    part = (F.col("result.verdict") == "MATCH") & F.col("key").isin(*th.whole_phrase_fields) & F.col("joined")
    small = F.lit(False)
    if heights is not None:
        tall = heights.groupBy("label_id").agg(F.max("height").alias("tallest"))
        own = rows.join(shuffled(heights), "label_id").where("line_no between line_start and line_end").groupBy("label_id", "key").agg(F.max("height").alias("own"))
        rows = rows.join(shuffled(tall), "label_id", "left").join(shuffled(own), ["label_id", "key"], "left")
        small = F.coalesce((F.col("result.verdict") == "MATCH") & (F.col("key") == "brand_name") & (F.col("own") > 0) & (F.col("own") < th.brand_small_print_ratio * F.col("tallest")), F.lit(False))
    downgraded = first_of((part, verdict("NEAR MATCH", 100, "part_of_phrase", F.col("found"))), (small, verdict("NEAR MATCH", 100, "small_print", F.col("found"))), (F.lit(True), F.col("result")))
    return rows.select("label_id", "key", "expected", downgraded.alias("result"), "line_start", "line_end")


def conflicting_readings(located: DataFrame, lines: DataFrame, boxes: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Other readings (label_id, key, text) of the place where a value was found, that spell it differently. (MT5, JN6)

    located: (label_id, key, expected, line_start, line_end); boxes: (label_id, line_no, left, top, width, height).
    """
    from .geometry import overlap_share, union_box

    own = located.join(shuffled(boxes), "label_id").where("line_no between line_start and line_end").groupBy("label_id", "key", "expected", "line_start", "line_end").agg(union_box("left", "top", "width", "height").alias("box"))
    other = boxes.select("label_id", "line_no", F.struct("left", "top", "width", "height").alias("other"))
    near = own.join(shuffled(other), "label_id").where(~F.col("line_no").between(F.col("line_start"), F.col("line_end"))).where(overlap_share(F.col("box"), F.col("other")) >= th.same_place_overlap)
    values = near.select("label_id", F.concat_ws("|", "key", "line_no").alias("key"), "expected", F.col("key").alias("field"), "line_no")
    single = lines.join(shuffled(values.select("label_id", "line_no").distinct()), ["label_id", "line_no"], "left_semi")
    one_line = Thresholds(locate_max_lines=1)
    alternatives = locate(values, single, floor=th.conflict_floor, th=one_line).join(shuffled(values.drop("expected")), ["label_id", "key"]).where("line_start = line_no")
    want, got = shape_fold("expected"), shape_fold("text")
    return alternatives.where((got != "") & (got != want) & ~want.contains(got)).select("label_id", F.col("field").alias("key"), "text", "line_no")


# Figures (MT7, MT8)


def compare_alcohol(value: Column, statements: Column, whole: Column, th: Thresholds = THRESHOLDS, statement: bool = False) -> Column:
    """Verdict of alcohol content. value: the application's; statements: the label's marked ones; whole: what its text as a whole parses to."""
    near = lambda x, y, tolerance: F.abs(x - y) <= tolerance + 1e-9
    fits = lambda c: near(c["abv"], value["abv"], th.abv_tolerance)
    fallback = F.filter(F.array(whole), lambda c: c["abv"].isNotNull()) if statement else F.array().cast("array<struct<abv:double,proof:double,from_proof:boolean,text:string>>")
    c = F.when(F.size(statements) > 0, statements).otherwise(fallback)
    matching, others = F.filter(c, fits), F.filter(c, lambda x: ~fits(x))
    got = F.coalesce(F.get(matching, F.lit(0)), F.get(c, F.lit(0)))
    contradicts = F.coalesce(~got["from_proof"] & ~near(got["proof"], 2 * got["abv"], th.proof_tolerance), F.lit(False))
    proofs = F.filter(F.transform(c, lambda x: x["proof"]), lambda p: p.isNotNull())
    states_proof = value["proof"].isNotNull() & ~value["from_proof"]
    everything = F.array_join(F.array_distinct(F.transform(c, lambda x: x["text"])), "; ")
    some = F.size(matching) > 0
    return first_of(
        (value["abv"].isNull(), verdict("NOT FOUND", 0, "application_unreadable", F.lit(None))),
        ((F.size(c) == 0) & near(whole["abv"], value["abv"], th.abv_tolerance), verdict("NEAR MATCH", 60, "unmarked", whole["text"])),
        ((F.size(c) == 0) & whole["abv"].isNotNull(), verdict("NOT FOUND", 0, "unmarked_other", F.lit(None))),
        (F.size(c) == 0, verdict("NOT FOUND", 0, "no_figure", F.lit(None))),
        (some & (F.size(others) > 0), verdict("NEAR MATCH", 80, "also_reads", everything)),
        (some & states_proof & (F.size(proofs) > 0) & F.forall(proofs, lambda p: ~near(p, value["proof"], th.proof_tolerance)), verdict("MISMATCH", 0, "proof_differs", everything)),
        (some & states_proof & (F.size(proofs) == 0) & ~near(value["proof"], 2 * value["abv"], th.proof_tolerance), verdict("NEAR MATCH", 80, "application_contradicts", got["text"])),
        (some & contradicts, verdict("NEAR MATCH", 90, "label_contradicts", got["text"])),
        (some, verdict("MATCH", 100, "same", got["text"])),
        (F.lit(True), verdict("MISMATCH", 0, "differs", got["text"])),
    )


def same_volume(a: Column, b: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Half a millilitre within a system of units; half a percent of b between systems. (MA2)"""
    cross = a["unit"].isin(*METRIC) != b["unit"].isin(*METRIC)
    return F.abs(a["ml"] - b["ml"]) <= F.when(cross, F.greatest(F.lit(th.volume_tolerance_ml), th.volume_cross_share * b["ml"])).otherwise(F.lit(th.volume_tolerance_ml)) + 1e-9


def compare_volume(value: Column, c: Column, th: Thresholds = THRESHOLDS) -> Column:
    """Verdict of net contents. value: the application's; c: all of the label's volumes."""
    same = lambda x: same_volume(x, value, th)
    no_point = lambda x: ~x["text"].contains(".")
    metric_first = lambda a: F.coalesce(F.get(F.filter(a, lambda x: x["unit"].isin(*METRIC)), F.lit(0)), F.get(a, F.lit(0)))
    matching = F.filter(c, same)
    others = F.filter(c, lambda x: ~same(x) & ~(no_point(x) & F.exists(matching, lambda m: (m["unit"] == x["unit"]) & (m["digits"] == x["digits"]))))
    got, some = metric_first(c), F.size(matching) > 0
    whole = lambda x: F.bround(x["ml"], 0).cast("int")
    misread = whole(value).isin(*STANDARD_ML) & ~whole(got).isin(*STANDARD_ML) & similarity.one_digit_apart(whole(got), whole(value))
    rivals = F.exists(F.array(*[F.lit(v) for v in STANDARD_ML]), lambda v: (v != whole(value)) & similarity.one_digit_apart(whole(got), v))
    return first_of(
        (value["ml"].isNull(), verdict("NOT FOUND", 0, "application_unreadable", F.lit(None))),
        (F.size(c) == 0, verdict("NOT FOUND", 0, "no_figure", F.lit(None))),
        (some & (F.size(others) > 0), verdict("NEAR MATCH", 80, "also_reads", F.array_join(F.array_distinct(F.transform(c, lambda x: x["text"])), "; "))),
        (some, verdict("MATCH", 100, "same", metric_first(matching)["text"])),
        ((got["unit"] == value["unit"]) & (got["digits"] == value["digits"]) & no_point(got), verdict("NEAR MATCH", 90, "lost_point", got["text"])),
        (misread & rivals, verdict("NEAR MATCH", 85, "ambiguous_misread", got["text"])),
        (misread, verdict("NEAR MATCH", 85, "probable_misread", got["text"])),
        (F.lit(True), verdict("MISMATCH", 0, "differs", got["text"])),
    )


def superseded(page: Column, closer: Column, agrees, harmless, figure, th: Thresholds = THRESHOLDS) -> Column:
    """Statements of the page without those that closer readings of their line correct. (MT9)

    All closer readings must agree with the application, but for harmless ones; a page's statement goes if its digits are at
    most reread_max_edits from theirs.
    """
    good = F.filter(closer, agrees)
    settled = (F.size(good) > 0) & ~F.exists(closer, lambda c: ~agrees(c) & ~harmless(c))
    keeps = lambda c: agrees(c) | (F.levenshtein(figure(c), figure(F.get(good, F.lit(0)))) > th.reread_max_edits)
    return F.when(settled, F.filter(page, keeps)).otherwise(page)


# Country (MT11)


def bare_country(expected: Column) -> Column:
    """Without an introduction such as "product of"."""
    return F.btrim(F.regexp_replace(F.trim(expected), "(?i)^(" + "|".join(ORIGIN_PREFIXES) + ")", ""), F.lit(" :,-"))


def compare_country(values: DataFrame, lines: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Rows (label_id, expected, result) for values (label_id, expected): statements of origin decide, then a line of its own, then a mention."""
    pages = lines.groupBy("label_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: normalize_strict(x["text"])).alias("lines"))
    rows = values.select("label_id", "expected", bare_country(F.col("expected")).alias("country")).join(shuffled(pages), "label_id", "left")
    rows = rows.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    rows = rows.withColumns({"want": country_key("country"), "said": F.transform(figures.origin_statements(F.col("lines")), lambda x: F.struct(x["statement"].alias("statement"), x["country"].alias("country"), country_key(x["country"]).alias("key")))})
    other = rows.select("label_id", "expected", "want", F.posexplode("said").alias("at", "s")).where("s.key <> want").withColumn("key", F.col("s.key")).withColumn("score", similarity.ratio("want", "key"))
    best = other.groupBy("label_id", "expected").agg(F.max_by(F.struct("score", "s.statement"), F.struct("score", -F.col("at"))).alias("best"))
    mention = locate(rows.select("label_id", F.lit("country").alias("key"), F.col("country").alias("expected")), lines, floor=th.near_match, th=th).select("label_id", F.col("expected").alias("country"), F.struct("score", "text").alias("mention"))
    rows = rows.join(shuffled(best), ["label_id", "expected"], "left").join(shuffled(mention), ["label_id", "country"], "left")
    same, stated = F.filter("said", lambda s: s["key"] == F.col("want")), F.size("said") > 0
    alone = F.filter("lines", lambda x: country_key(x) == F.col("want"))
    result = first_of(
        (F.trim("expected") == "", verdict("SKIPPED", 0, "not_given", F.lit(None))),
        (stated & (F.size(same) == F.size("said")), verdict("MATCH", 100, "stated", F.get(same, F.lit(0))["statement"])),
        (stated & (F.size(same) > 0), verdict("NEAR MATCH", 100, "several_countries", F.array_join(F.transform("said", lambda s: s["statement"]), "; "))),
        (stated & (F.col("best.score") >= th.near_match), verdict("NEAR MATCH", F.col("best.score"), "close_country", F.col("best.statement"))),
        (stated, verdict("MISMATCH", F.col("best.score"), "other_country", F.col("best.statement"))),
        (F.size(alone) > 0, verdict("MATCH", 100, "on_its_own_line", F.get(alone, F.lit(0)))),
        (F.col("mention").isNotNull(), verdict("NEAR MATCH", F.col("mention.score"), "mentioned", F.col("mention.text"))),
        (F.lit(True), verdict("NOT FOUND", 0, "no_statement", F.lit(None))),
    )
    return rows.select("label_id", "expected", result.alias("result"))


def wants_reread(key: Column, result: Column) -> Column:
    """The kind of figure that a closer reading of its line could settle, or null. (FLT9)"""
    doubtful = result["code"].isin("also_reads", "lost_point", "probable_misread", "ambiguous_misread", "label_contradicts")
    missing = result["verdict"].isin("NOT FOUND", "MISMATCH") & (result["code"] != "application_unreadable")
    kind = F.when(key == "alcohol_content", "alcohol").when(key == "net_contents", "volume")
    return F.when(doubtful | missing, kind)


def note(label: Column, result: Column) -> Column:
    """A sentence for the reviewer, rendered from the verdict's code."""
    texts = {
        "exact": "Exact match.", "loose": "Matches but for case and punctuation.", "letter_spaced": "Matches, with its letters spaced out.", "case_differs": "Same words in other case or punctuation. Please confirm.",
        "one_letter": "One letter differs. Please confirm.", "different": "Does not match the application.", "not_found": "Not found on the label.", "required": "Required on the application.", "not_given": "Not given on the application, so not checked.",
        "part_of_phrase": "Only part of what the label says. Please confirm.", "small_print": "Found only in small print. Please confirm.", "application_unreadable": "The application's value could not be read.",
        "also_reads": "On the label, which also reads something else. Please confirm.", "same": "The same on both.", "differs": "Differs from the application.", "lost_point": "The decimal point was not read clearly. Please confirm.",
    }
    known = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    similar = F.concat(F.lit("Very similar ("), general_number(result["score"].cast("double")), F.lit("% alike) but not identical. Please confirm."))
    return F.concat(label, F.lit(": "), F.when(result["code"] == "similar", similar).otherwise(F.coalesce(known[result["code"]], result["code"])))
