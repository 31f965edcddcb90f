"""URL filters: rules by host and path, and trust spread over the graph of links between hosts.

Pages that a rule fits take the rule's verdict. For the others the hosts decide: the share of a host's pages that rules
allow is its trust seed, the share that rules block its distrust seed. Trust follows links (personalised PageRank),
distrust runs against them (a host that links to blocked hosts becomes suspect). What a host gets in this way falls with
the number of hosts that it is shared among, so it is judged as a share: of what would have reached the host if every host
were trusted, or blocked. The host's own seed counts in this only if rules fit some of its pages; for other hosts their
links alone speak. This catches hosts that link to blocked ones themselves; after further steps a share is small again, as
the hosts in between might have been blocked and are not. A host is blocked if its share of distrust is at least `threshold` and greater than its share of trust.
Links from a host to itself count for nothing, and what hosts without links would pass on is lost.

All steps are DataFrame expressions, joins and aggregations. Links and pages are reduced to host pairs and hosts before
anything is shuffled by host, so a host with a third of all pages adds one row per task; the join that gives the pages
their host's scores is a plain equi-join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import ascii_lower, written

#: Rules of a list up to which they are one expression; more are joined.
FEW_RULES = 1_000
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def after_scheme(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both are empty for a null url or one without '://'."""
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return pages.withColumns({"host": ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def with_rule(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds rule and ruled (the rule's verdict) of the longest rule that fits, or nulls; ties go to the greater text, then verdict.

    rules: (verdict, 'host/path'), as a list or as a DataFrame (verdict, rule). Up to FEW_RULES of a list are one expression;
    more are joined (with_rule_table), with the same result.
    """
    if isinstance(rules, DataFrame):
        return with_rule_table(pages, rules)
    if len(rules) > FEW_RULES:
        return with_rule_table(pages, pages.sparkSession.createDataFrame(rules, "verdict string, rule string"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(set(rules), key=lambda r: (len(r[1]), r[1], r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def with_rule_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """with_rule() for any number of rules (verdict, rule): equi-joins, so a page meets only rules that fit it.

    Distinct (host, path) alone take part. Each suffix of a host at a dot meets the lengths that rule paths of that host
    have, and the path's beginnings of these lengths meet the rules. Rules that are null fit nothing.
    """
    own = rules.filter("rule is not null").select(
        F.col("rule"), F.col("verdict").alias("says"), F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("if(instr(rule, '/') > 0, substring(rule, instr(rule, '/')), '')").alias("head")
    )
    lengths = own.select("rule_host", F.length("head").alias("n")).distinct()
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    ends = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    heads = ends.join(lengths, "rule_host").filter(F.length("path") >= F.col("n")).withColumn("head", F.expr("substring(path, 1, n)"))
    best = heads.join(own, ["rule_host", "head"]).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "says")).alias("best"))
    found = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.says").alias("ruled"))
    return pages.join(found, ["host", "path"], "left").select(*pages.columns, "rule", "ruled")


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): pages of src that link to the other host dst. pages needs host."""
    links = pages.filter(F.col(html).contains("//")).select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), ascii_lower))).alias("dst"))
    return links.filter((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 8) -> DataFrame:
    """(host, trust, distrust, trust_share, distrust_share) after so many rounds; seeds: (host, trust_seed, distrust_seed, known: 1.0 if rules fit some pages, else 0.0)."""
    out, into = links.groupBy("src").agg(F.sum("n").alias("total")), links.groupBy("dst").agg(F.sum("n").alias("total"))
    along = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("w"), F.lit(0.0).alias("v"))
    against = links.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("w"), (F.col("n") / F.col("total")).alias("v"))
    steps = written(along.unionByName(against))
    marks = ("trust_seed", "distrust_seed", "known")
    linked = links.select(F.explode(F.array("src", "dst")).alias("host"), *(F.lit(0.0).alias(m) for m in marks))
    hosts = written(seeds.select("host", *marks).unionByName(linked).groupBy("host").agg(*(F.sum(m).alias(m) for m in marks)))
    most = 1 - damping
    base = hosts.select("host", (most * F.col("trust_seed")).alias("t0"), (most * F.col("distrust_seed")).alias("d0"), (most * F.col("known")).alias("own"))
    state = base.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"), F.lit(most).alias("all_trust"), F.lit(most).alias("all_distrust"))
    for i in range(rounds):
        passed = {"gt": ("w", "trust"), "gd": ("v", "distrust"), "gat": ("w", "all_trust"), "gad": ("v", "all_distrust")}
        gained = steps.join(state, "host").groupBy(F.col("to").alias("host")).agg(*(F.sum(F.col(w) * F.col(x)).alias(g) for g, (w, x) in passed.items()))
        got = {g: damping * F.coalesce(g, F.lit(0.0)) for g in passed}
        now = {"trust": F.col("t0") + got["gt"], "distrust": F.col("d0") + got["gd"], "all_trust": most + got["gat"], "all_distrust": most + got["gad"]}
        if i == rounds - 1:
            share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
            now = {k: now[k] for k in ("trust", "distrust")} | {"trust_share": share(now["trust"], F.col("own") + got["gat"]), "distrust_share": share(now["distrust"], F.col("own") + got["gad"])}
        state = base.join(gained, "host", "left").select("host", *(c.alias(k) for k, c in now.items()))
        if i % 3 == 2 or i == rounds - 1:
            state = written(state)
    return state


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, damping: float = 0.85, rounds: int = 8, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict, trust, distrust and the shares of both to pages (columns url and html).

    Null urls and urls without '://' have host and path '' and are judged as pages of the host '', which takes no part in
    links. Null or empty html has no links. Repeated rows are all kept. An empty table gives an empty result. Columns of
    pages named host, path, rule, ruled, verdict, trust, distrust, trust_share or distrust_share are replaced or left out.
    """
    pages = pages.drop("host", "path", "rule", "ruled", "verdict", "trust", "distrust", "trust_share", "distrust_share")
    judged = with_rule(split_url(pages), rules)
    seeds = judged.groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trust_seed"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("distrust_seed"), F.max(F.when(F.col("ruled").isNotNull(), 1.0).otherwise(0.0)).alias("known"))
    scores = spread(written(host_links(judged)), seeds, damping, rounds)
    suspect = F.round("distrust_share", 9)  # off the ties of rounding
    blocked = (suspect >= threshold) & (suspect > F.round("trust_share", 9))
    return judged.join(scores, "host").withColumn("verdict", F.coalesce("ruled", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))).drop("ruled")
