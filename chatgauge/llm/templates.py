"""URL filters: rules first, then a path-template tree per host.

A url's path becomes a chain of segments with numbers and long hexadecimal runs as
placeholders. Level by level below each host the tree is generalised: at a node with more
than WIDE kinds of segments the rare ones become the wildcard ``*``; then branches that look
like the node's largest branch (what follows them, and how often labelled urls below them
are rejected) are merged with it. Every template gets the share of rejected urls among its
labelled ones, smoothed towards one half by PRIOR urls, and is rejected from PURITY on; so
one without labelled urls never is, nor is it merged with one of a clear share.

Rounds work on distinct (host, shape) rows with counts, never on urls; all steps are built-in
aggregates and joins on (host, template, segment), so a host with a third of all urls is
counted map-side first and its join partitions can be split. Where everything below a node
goes on with the same segments, one round passes them all, so paths of any depth take as many
rounds as they have forks.

Defined results: a null url or one without ``://`` has empty host and path and template
``/``; the longest matching rule wins, ties (equal host and path, different verdicts) go to
block; without labelled urls nothing is rejected; repeated rows are judged alike; an empty
table gives an empty result. Further columns of any name do not matter.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (host, path, verdict): fixed values of the contract.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
WIDE = 20
PRIOR, PURITY = 4.0, 0.75
ALIKE, CLOSE = 0.25, 0.2


def parts(url: Column):
    """(host, path) of a url; both empty for null or without ``://``."""
    rest = F.when(url.contains("://"), F.expr("substring({0}, instr({0}, '://') + 3)".format("url_of_page"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, shape): shape is the array of generalised segments."""
    split = pages.select("page_id", F.col("url").alias("url_of_page"))
    host, path = parts(F.col("url_of_page"))
    shaped = split.select("page_id", host.alias("host"), path.alias("path"))
    segment = (
        r"regexp_replace(if(s RLIKE '^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$' AND length(s) >= 16, '{x}', s), '[0-9]+', '{n}')"
    )
    return shaped.selectExpr(
        "page_id", "host", "path",
        rf"transform(slice(split(path, '/'), 2, greatest(size(split(path, '/')) - 1, 0)), s -> {segment}) AS shape",
    )


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add rule (``host`` + path, null if none fits) and rule_verdict."""
    # a rule fits its host and subdomains; the longest host and path come first, block before allow
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r))
    fits = lambda h, p: f"(host = '{h}' OR endswith(host, '.{h}')) AND startswith(path, '{p}')"
    cases = " ".join(f"WHEN {fits(h, p)} THEN struct('{h}{p}' AS rule, '{v}' AS verdict)" for h, p, v in ordered)
    found = F.expr(f"CASE {cases} END") if cases else F.lit(None).cast("struct<rule: string, verdict: string>")
    return urls.withColumn("found_rule", found).select(
        *urls.columns, F.col("found_rule.rule").alias("rule"), F.col("found_rule.verdict").alias("rule_verdict")
    )


SHARE = f"(rejected + {PRIOR / 2}D) / (labelled + {PRIOR}D)"
COUNTS = ("n", "labelled", "rejected", "k_end", "k_number", "k_hex", "k_word")


def _sums():
    return [F.sum(c).alias(c) for c in COUNTS]


def _round(rows: DataFrame) -> DataFrame:
    """Extend ``template`` and ``share`` of rows that go on past their first ``at`` segments."""
    node = ["host", "template", "at"]
    open_rows = rows.where("size(shape) > at").withColumn("rest", F.expr("slice(shape, at + 1, size(shape) - at)"))
    # what all of a node's shapes begin with is what its first and last one in order begin with
    ends = open_rows.groupBy(*node).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    same = "filter(sequence(1, least(size(low), size(high))), i -> low[i - 1] <> high[i - 1])"
    width = ends.selectExpr(*node, f"greatest(1, coalesce(get({same}, 0) - 1, least(size(low), size(high)))) AS width")
    kid = "get(rest, width)"
    here = open_rows.join(width, node).selectExpr(
        *node, "shape", "n", "labelled", "rejected", "width", "array_join(slice(rest, 1, width), '/') AS segment",
        f"if({kid} IS NULL, n, 0L) AS k_end", f"if({kid} LIKE '%{{n}}%', n, 0L) AS k_number",
        f"if({kid} LIKE '%{{x}}%' AND {kid} NOT LIKE '%{{n}}%', n, 0L) AS k_hex",
        f"if({kid} NOT LIKE '%{{n}}%' AND {kid} NOT LIKE '%{{x}}%', n, 0L) AS k_word",
    )
    by_segment = here.groupBy(*node, "segment").agg(*_sums())
    fan = by_segment.groupBy(*node).agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"))
    wide = f"if(kinds > {WIDE} AND n * {WIDE} < all_n, '*', segment)"
    named = by_segment.join(fan, node).withColumn("branch", F.expr(wide)).drop("kinds", "all_n")
    branches = named.groupBy(*node, "branch").agg(*_sums()).withColumn("branch_share", F.expr(SHARE))
    facts = F.struct("branch", "branch_share", *COUNTS)
    leads = branches.groupBy(*node).agg(F.max_by(facts, F.struct("n", "branch")).alias("lead"))
    apart = " + ".join(f"abs({k} / n - lead.{k} / lead.n)" for k in COUNTS[3:])
    alike = f"({apart}) / 2 <= {ALIKE} AND abs(branch_share - lead.branch_share) <= {CLOSE}"
    joined = branches.join(leads, node).withColumn("merged", F.expr(f"if({alike}, lead.branch, branch)")).drop("lead")
    groups = joined.groupBy(*node, "merged").agg(
        F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected"),
        F.sort_array(F.collect_set("branch")).alias("names"),  # at most WIDE + 1 branches below a node
    ).selectExpr(
        *node, "merged",
        "if(size(names) = 1, names[0], concat('(', array_join(names, '|'), ')')) AS label",
        f"{SHARE} AS new_share",
    )
    to_group = joined.select(*node, "branch", "merged").join(groups, [*node, "merged"]).drop("merged")
    to_label = named.select(*node, "segment", "branch").join(to_group, [*node, "branch"]).drop("branch")
    longer = here.join(to_label, [*node, "segment"]).selectExpr(
        "host", "concat(template, if(template = '/', '', '/'), label) AS template", "at + width AS at", "new_share AS share",
        "shape", "n", "labelled", "rejected",
    )
    ended = rows.where("size(shape) <= at").select(*longer.columns)
    return longer.unionByName(ended)


def tree(urls: DataFrame) -> DataFrame:
    """(host, shape, template, share) from (host, shape, label); label is 1 for a rejected url, null if unlabelled."""
    shapes = urls.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("rejected")
    )
    shapes = cut(shapes)
    whole = shapes.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected"))
    hosts = whole.selectExpr("host", f"{SHARE} AS share")
    rows = shapes.join(hosts, "host").selectExpr(
        "host", "'/' AS template", "0 AS at", "share", "shape", "n", "labelled", "rejected"
    )
    while not rows.where("size(shape) > at").isEmpty():
        rows = cut(_round(rows))
    return rows.select("host", "shape", "template", "share")


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, template, share, verdict) for every row of (page_id, url).

    ``labels`` (page_id, label) says which urls were rejected (1) or accepted (0); without it
    the urls that the rules decide are the labelled ones.
    """
    urls = with_rule(split_urls(pages), rules)
    if labels is None:
        learned = urls.selectExpr("host", "shape", "if(rule IS NULL, NULL, CAST(rule_verdict = 'block' AS INT)) AS label")
    else:
        marks = labels.groupBy("page_id").agg(F.max("label").cast("int").alias("label"))
        learned = urls.join(marks, "page_id", "left").select("host", "shape", "label")
    known = tree(learned)
    judged = urls.join(known, ["host", "shape"])
    return judged.selectExpr(
        "page_id", "host", "path", "rule", "template", "share",
        f"coalesce(rule_verdict, if(share >= {PURITY}, 'block', 'allow')) AS verdict",
    )
