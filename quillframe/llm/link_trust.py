"""URL filtering by link-graph propagation, in built-in SQL functions only.

Rules decide the urls that they fit. Hosts whose pages the rules mostly allow, or mostly block, are the trusted and the
blocked seeds of two walks over the links between hosts: personalised PageRank from the trusted seeds, along the links,
and distrust from the blocked seeds, against them. Pages that no rule fits get the verdict of their host.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import durable

#: (host, path, verdict); an empty list leaves all to the links.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative links of a page, whatever their length; relative ones stay on their host. White space is
#: HTML's. Where no link follows up to the next ``>``, none begins before it: the second branch, an empty group, takes all of that, so the time stays in proportion to the page.
LINK = r"""(?i)<a_(?:(?:[^>]*?_)?href_*+=_*+["']?_*+(?:https?:)?//([^/?#"'_>]++)|[^>]*+)""".replace('"\'_>', '"\' \\t\\n\\f\\r>').replace("_", r"[ \t\n\f\r]")
#: Weight of the links in a step of the walk; share of the threshold that all steps after the last one may amount to for a host.
DAMPING, TOLERANCE = 0.85, 1e-2
#: A host is blocked if its distrust exceeds this share of what a blocked seed has of itself, and its trust. Blocked seeds are.
THRESHOLD = 0.25


def rounds_for(hosts: int) -> int:
    """Steps after which all that is still to come, DAMPING ** steps / (1 - DAMPING) for each seed among ``hosts``, is below a tolerance of
    the threshold."""
    return math.ceil(math.log(TOLERANCE * THRESHOLD * (1 - DAMPING) / max(1, hosts)) / math.log(DAMPING))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or url."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], field: str = "rule") -> Column:
    """The longest rule that fits the host or one of its parents and begins the path: its text, or its verdict; else null."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda x: len(x[0] + x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p if field == "rule" else verdict)).otherwise(out)
    return out


def _walk(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Personalised PageRank: (host, score) in units of what each seed has of itself, so that scores do not depend on the number of seeds.

    ``edges`` (a, b, share): the share of a's score that goes to b; ``seeds`` (host, seed) have 1 each. Scores that reach a
    host without links leave the walk. What is on the way after k steps is (links ** k) of the seeds, and a score is the sum
    of all of it: each step is one join and one aggregation with partial sums, and the walk ends when nothing moves.
    """
    moving = durable(seeds.select("host", F.col("seed").alias("score")), "moving")
    total = moving
    for step in range(rounds):
        moved = edges.join(moving, edges["a"] == moving["host"]).groupBy(F.col("b").alias("host")).agg(F.sum(F.col("score") * F.col("share") * DAMPING).alias("score"))
        moving = durable(moved, "moving")
        if moving.isEmpty():
            break
        total = total.unionByName(moving)
        if step % 10 == 9:
            total = durable(total.groupBy("host").agg(F.sum("score").alias("score")), "total")
    return durable(total.groupBy("host").agg(F.sum("score").alias("score")), "scores")


def host_scores(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, trust, distrust, seed): scores in units of what a seed has of itself; hosts without either are 0. ``seed`` tells blocked ones."""
    rules = RULES if rules is None else rules
    host = host_of(F.col(url_col))
    links = F.when(F.col(html_col).contains("//"), F.array_remove(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), ""))
    read = pages.select(host.alias("host"), rule_of(host, path_of(F.col(url_col)), rules, "verdict").alias("verdict"), F.col(html_col).alias("html"))
    hosts = durable(
        read.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")), "hosts"
    ).where("host <> ''")
    out = pages.select(host.alias("a"), F.explode(links).alias("b")).select("a", F.translate("b", UPPER, LOWER).alias("b")).where("a <> '' AND a <> b")
    edges = durable(out.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "links")
    seeds = hosts.select("host", (F.col("allowed") * 2 > F.col("pages")).cast("double").alias("good"), (F.col("blocked") * 2 > F.col("pages")).cast("double").alias("bad"))
    n = seeds.count()
    linked = not edges.isEmpty()

    def scores(frm: str, to: str, seed: str) -> DataFrame:
        chosen = seeds.where(F.col(seed) > 0).select("host", F.col(seed).alias("seed"))
        if not linked:
            return chosen.select("host", F.col("seed").alias("score"))  # what the walk gives
        # Written, so that both sides of the join are plain shuffles: Spark splits a popular host's partition then.
        sums = durable(edges.groupBy(frm).agg(F.sum("n").alias("all")), "sums")
        shares = edges.join(sums, frm).select(F.col(frm).alias("a"), F.col(to).alias("b"), (F.col("n") / F.col("all")).alias("share"))
        return _walk(durable(shares, "shares"), durable(chosen, "seeds"), rounds_for(n))

    trust = scores("a", "b", "good").select("host", F.col("score").alias("trust"))
    distrust = scores("b", "a", "bad").select("host", F.col("score").alias("distrust"))
    joined = hosts.select("host", "pages", (F.col("blocked") * 2 > F.col("pages")).alias("seed")).join(trust, "host", "left").join(distrust, "host", "left")
    return joined.select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), "seed")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    A null url, or one without ``://``, has an empty host and path, fits no rule and, having no host, is allowed. A
    null ``html`` has no links. Null and repeated ids are rows like others. Other columns are not read. The html of a page is
    read by one scan for its links and goes no further.
    """
    rules = RULES if rules is None else rules
    bad = durable(host_scores(pages, rules, url_col, html_col).where(F.col("seed") | ((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")))).select("host"), "bad-hosts")
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "said": rule_of(F.col("host"), F.col("path"), rules, "verdict")})
    # A host may have a third of all pages: Spark splits its partition, as this join is all that the shuffle is for.
    found = judged.join(bad.withColumn("bad", F.lit(True)), "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
