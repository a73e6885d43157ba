"""URL filters: rules on hosts and paths, and trust and distrust that spread over the links between hosts.

Trust is a personalised PageRank from hosts whose pages the rules allow; distrust is one over the reversed links, from
hosts whose pages they block, since a host is judged by what it links to. Seeds weigh as many pages as the rules judged.
A host is blocked where its distrust is above its trust times a threshold. A host that neither reaches is allowed.
"""

from __future__ import annotations

import string
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

DAMPING, ROUNDS, THRESHOLD, LINEAGE = 0.85, 12, 1.0, 4

#: What the last LINEAGE rounds may change of all mass at most, the seeds' mass being 1 - DAMPING.
TOLERANCE = 1e-12

HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'>\s]+)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts. Links without a host stay on theirs, so say nothing about others."""
    links = pages.select(host_of(F.col(f"`{url_col}`")).alias("src"), F.explode(F.regexp_extract_all(F.col(f"`{html_col}`").cast("string"), F.lit(HREF), F.lit(1))).alias("href"))
    ends = links.select("src", host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))).alias("dst"))
    return ends.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, links) and seeds (host, allowed, blocked), in pages.

    Mass of a host without links to follow is not dealt out again. Both scores are shares of all seeds. Without a number of
    rounds, mass spreads until LINEAGE rounds reach no further host and change no more than TOLERANCE of it.
    """
    both = edges.select(F.lit(True).alias("good"), "src", "dst", "links").unionByName(edges.select(F.lit(False).alias("good"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    total = both.groupBy("good", "src").agg(F.sum("links").alias("all"))
    both = checkpoint(both.join(total, ["good", "src"]).select("good", "src", "dst", (F.col("links") / F.col("all")).alias("share")))
    long = seeds.select(F.explode(F.array(F.struct(F.lit(True).alias("good"), "host", F.col("allowed").alias("n")), F.struct(F.lit(False).alias("good"), "host", F.col("blocked").alias("n")))).alias("s")).select("s.*").where("n > 0")
    pages = long.agg(F.sum("n")).first()[0] or 1
    start = checkpoint(long.select("good", "host", (F.col("n") * ((1 - damping) / pages)).alias("mass")))
    state, before = start, None
    if not both.isEmpty():
        for k in count() if rounds is None else range(rounds):
            moved = state.join(both.withColumnRenamed("src", "host"), ["good", "host"]).select("good", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
            state = start.unionByName(moved).groupBy("good", "host").agg(F.sum("mass").alias("mass"))
            if k % LINEAGE == LINEAGE - 1:
                state = checkpoint(state)
                # mass only grows from round to round, so the change of its sum is the sum of all changes
                now = state.agg(F.count(F.lit(1)), F.coalesce(F.sum("mass"), F.lit(0.0))).first() if rounds is None else None
                if before and now[0] == before[0] and now[1] - before[1] <= TOLERANCE:
                    break
                before = now
    score = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("mass"))), F.lit(0.0))
    return state.groupBy("host").agg(score(True).alias("trust"), score(False).alias("distrust"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages.

    Null urls and those without :// have an empty host and path and are allowed, as no rule or link reaches them. Null
    html has no links. Repeated rows are judged and counted each on its own. Empty table: no rows. Other columns are
    not read.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    number = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)).alias(v + "ed")
    seeds = rows.groupBy("host").agg(number("allow"), number("block"))
    scores = checkpoint(spread(host_edges(pages, url_col, html_col), seeds, rounds=None))
    by_method = F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow")
    out = rows.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "trust", "distrust")
