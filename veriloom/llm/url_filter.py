"""URL filters: host rules, and a tree of path templates whose branches are judged by their labelled pages. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

#: A segment becomes a wildcard if its branch point has KIDS different segments or more, and the segment itself fewer than SUPPORT pages.
KIDS, SUPPORT = 16, 4
#: Branches merge unless their labelled shares differ from their siblings' by so many standard errors.
DIFFERENT = 2.58
#: Weight of the parent's purity in a branch's own, in labelled pages; purity from which a template is rejected.
PRIOR, REJECT = 5.0, 0.9

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path: after the first ://, up to / ? or #, in lower case; then up to ? or #. Both empty without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(url, pattern, 1)), "path": F.regexp_extract(url, pattern, 2)})


def rule_columns(rules, host="host", path="path") -> tuple[F.Column, F.Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls. The rules are configuration: a chain of tests in each row."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((F.col(host) == own) | F.col(host).endswith("." + own)) & F.col(path).startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def skeleton(path) -> F.Column:
    """The segments of a path with their runs of digits and long hexadecimal strings as wildcards."""
    marked = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<=/)[0-9a-f]*[0-9][0-9a-f]{7,}(?=[/.]|$)", "{h}"), r"[0-9]+", "{n}")
    parts = F.split(F.regexp_replace(marked, r"^/", ""), "/")
    return F.when(F.length(path) == 0, F.array().cast("array<string>")).otherwise(parts)


def _apart() -> F.Column:
    """Whether a branch's labelled share differs from that of its siblings together by more than DIFFERENT standard errors."""
    n, m = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
    rate = F.col("all_bad") / F.nullif(n + m, F.lit(0))
    gap = F.abs(F.col("bad") / F.nullif(n, F.lit(0)) - (F.col("all_bad") - F.col("bad")) / F.nullif(m, F.lit(0)))
    return F.coalesce(gap > DIFFERENT * F.sqrt(rate * (1 - rate) * (1 / F.nullif(n, F.lit(0)) + 1 / F.nullif(m, F.lit(0)))), F.lit(False))


def templates(judged: DataFrame) -> DataFrame:
    """Rows (host, skeleton, template, pages, purity) from pages with host, path and label (allow, block or null).

    Pages are first counted by host and skeleton, which combines a common host's pages before any shuffle. The tree then grows
    level by level from the hosts down, as long as a branch holds two skeletons or more:
    1. rare segments of a branch point with many become wildcards;
    2. branches of one parent merge, inner ones too, unless their labelled shares differ significantly from their siblings' (a lone branch keeps its name, if paths go on below it);
    3. a branch's purity is its share of blocked labels, smoothed towards its parent's purity; so without labels of its own it
       has that of the nearest ancestor with labels, and hosts without any have the overall share.
    """
    leaves = judged.groupBy("host", skeleton(F.col("path")).alias("skeleton")).agg(
        F.count("*").alias("pages"), F.count_if(F.col("label") == "allow").alias("good"), F.count_if(F.col("label") == "block").alias("bad")
    )
    leaves = checkpointed(leaves)
    good, bad = leaves.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    smoothed = lambda parent: (F.col("bad") + PRIOR * parent) / (F.col("good") + F.col("bad") + PRIOR)
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("held").alias("held")]
    hosts = leaves.withColumn("held", F.lit(1)).groupBy("host").agg(*sums).select("host", smoothed(F.lit(bad / max(1, good + bad))).alias("purity"), "held")
    growing = leaves.join(hosts, "host").withColumns({"node": F.xxhash64("host"), "template": F.array().cast("array<string>")})
    grown = None
    columns = ["host", "skeleton", "pages", "good", "bad", "node", "template", "purity", "held"]
    for level in range(2**31):
        growing = checkpointed(growing.select(*columns))
        ended = (F.col("held") == 1) | (F.size("skeleton") < level)
        rest = F.slice("skeleton", level + 1, F.greatest(F.size("skeleton"), F.lit(1)))
        done = growing.where(ended).select("host", "skeleton", F.concat("template", rest).alias("template"), "pages", "purity")
        grown = done if grown is None else grown.unionByName(done)
        growing = growing.where(~ended).withColumn("segment", F.get("skeleton", F.lit(level)))
        if growing.isEmpty():
            return grown.withColumn("template", F.concat(F.lit("/"), F.array_join("template", "/")))
        kids = growing.groupBy("node", "segment", "purity").agg(F.sum("pages").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("held"), F.max(F.size("skeleton") > level + 1).alias("deeper"))
        wide = kids.groupBy("node").agg(F.count("segment").alias("kids"))
        rare = (F.col("kids") >= KIDS) & (F.col("n") < SUPPORT) & F.col("segment").isNotNull()
        kids = kids.join(wide, "node").withColumn("name", F.when(rare, F.lit("*")).otherwise(F.col("segment")))
        branch = kids.groupBy("node", "name", "purity").agg(*sums, F.max("deeper").alias("deeper"))
        family = branch.groupBy("node").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count("*").alias("branches"))
        own = _apart() | ((F.col("branches") == 1) & F.col("deeper")) | F.col("name").isNull()
        branch = branch.join(family, "node").withColumn("label", F.when(own, F.col("name")).otherwise(F.lit("**")))
        merged = branch.groupBy("node", "label", "purity").agg(*sums).select("node", "label", smoothed(F.col("purity")).alias("purity"), "held")
        same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
        named = branch.select(F.col("node").alias("_n"), F.col("name").alias("_name"), "label").join(merged.select(F.col("node").alias("_m"), F.col("label").alias("_label"), "purity", "held"), (F.col("_n") == F.col("_m")) & same("label", "_label"))
        told = kids.select(F.col("node").alias("_k"), F.col("segment").alias("_segment"), "name").join(named, (F.col("_k") == F.col("_n")) & same("name", "_name")).select("_k", "_segment", "label", "purity", "held")
        growing = growing.drop("purity", "held").join(told, (F.col("node") == F.col("_k")) & same("segment", "_segment"))
        growing = growing.withColumns({"node": F.xxhash64("node", F.coalesce("label", F.lit("/"))), "template": F.when(F.col("label").isNull(), F.col("template")).otherwise(F.concat("template", F.array("label")))})
    raise AssertionError


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """All rows and columns of pages (url, ...), with host, path, rule and verdict (allow or block).

    The longest rule that fits decides. The pages that rules decide are the labelled ones; the others are rejected if the
    purity of their template, the smoothed share of blocked pages, is REJECT or more. Templates without labelled pages go by
    their nearest ancestor with some, hosts without any by the overall share. A null url, and one without ://, has an empty
    host and path. Urls of any length and depth are told apart to the end; repeated pages count as often as they occur. Columns of
    these names are replaced; others are kept. An empty table gives no rows.
    """
    pages = with_parts(pages.drop("host", "path", "rule", "verdict", "_decided", "_skeleton"))
    rule, decided = rule_columns(rules)
    pages = pages.withColumns({"rule": rule, "_decided": decided})
    tree = templates(pages.select("host", "path", F.col("_decided").alias("label")))
    rejected = tree.where(F.col("purity") >= REJECT).select("host", F.col("skeleton").alias("_skeleton"), F.lit("block").alias("verdict"))
    pages = pages.withColumn("_skeleton", skeleton(F.col("path"))).join(rejected, ["host", "_skeleton"], "left")
    return pages.withColumn("verdict", F.coalesce("_decided", "verdict", F.lit("allow"))).drop("_decided", "_skeleton")
