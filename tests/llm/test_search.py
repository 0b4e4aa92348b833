"""Top-k search and URL judging against brute force."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import link_trust
from quillframe.llm.registry import ORACLE, _url_sql
from quillframe.llm.topk import HELD, grid, top_k
from tests.llm.helpers import plain


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "z") for i, x in rows], "vec_id long, embedding array<float>, rank int, score int, block string")


def brute(rows, k, every):
    valid = [(i, tuple(math.floor(64 * float(v)) for v in np.float32(x))) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for q, a in {(i, x) for i, x in valid if i % every == 0}:
        scores = [(-sum(x * y for x, y in zip(a, b)), c) for c, b in valid if c != q and len(a) == len(b)]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "bins"), [(5, 1024), (5, 3), (100, 64)])
def test_top_k(spark, k, bins):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(90)]
    rows += [(100, [0.5] * 6), (101, [0.5] * 6), (102, [0.5] * 6), (100, [0.5] * 6), (110, None), (111, []), (112, [None] * 6), (113, [float("nan")] * 6), (114, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (115, [1.0, 2.0]), (120, [3.0, 4.0]), (121, [1e6] * 6), (140, []), (7, rows[7][1]), (7, rows[7][1])]
    assert plain(top_k(vectors(spark, rows).repartition(3), k, 20, bins=bins)) == brute(rows, k, 20)


def test_blocks_are_sent_in_proportion_to_the_root_of_the_cells():
    for queries, blocks, tasks in ((3, 12, 24), (400, 1000, 632), (40_000, 100_000, 63_000)):
        a, b = grid(queries, blocks, tasks, 65536, 524288)
        assert 1 <= a <= queries and 1 <= b <= blocks and queries <= a * HELD
        assert blocks * 524288 * a + queries * 65536 * b <= 3 * math.sqrt(max(tasks, a)) * (blocks * 524288 + queries * 65536) or a == -(-queries // HELD)


def test_scores_beyond_floating_point(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 2.0])]
    assert [r[2:] for r in plain(top_k(vectors(spark, rows), 2))] == [(1, 2**62 + 64 * 192), (2, 2**62 + 64 * 128)]


def test_few_vectors(spark):
    assert top_k(vectors(spark, [])).count() == 0
    assert top_k(vectors(spark, [(20, [1.0])])).count() == 0
    assert top_k(vectors(spark, [(1, [1.0]), (2, [1.0])])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", False) for i, u, h in rows], "page_id long, url string, html string, host string, bad boolean")


def test_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "https://m.example.com/fr/1": ("m.example.com", "/fr/1", "com/", "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/fr": ("x.net", "/fr", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "a://b://c.com/d": ("b:", "//c.com/d", None, "allow"),
        "http://Ünï.com?x": ("Ünï.com", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://x.org/p\nq#z": ("x.org", "/p\nq", None, "allow"),
    }
    found = link_trust.judge_urls(pages(spark, [(i, u, None) for i, u in enumerate(cases)]))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == dict(enumerate(cases.values()))


def walk(edges, seeds, reverse):
    nodes = {x for e in edges for x in e} | set(seeds)
    shares = {}
    for (a, b), n in edges.items():
        a, b = (b, a) if reverse else (a, b)
        shares.setdefault(a, {})[b] = n
    score = dict.fromkeys(nodes, 0.0)
    for _ in range(400):
        new = {x: seeds.get(x, 0) * (1 - link_trust.DAMPING) for x in nodes}
        for a, out in shares.items():
            for b, n in out.items():
                new[b] += link_trust.DAMPING * score[a] * n / sum(out.values())
        score = new
    return score


def test_scores_follow_links(spark):
    links = {"good.com": ["fine.org", "fine.org", "mid.org"], "mid.org": ["fine.org"], "shady.org": ["bad.net", "good.com"], "worse.org": ["shady.org", "bad.net"], "bad.net": ["mid.org"], "lone.org": []}
    rows, n = [], 0
    for host, targets in links.items():
        path = "/es/" if host == "bad.net" else "/"
        html = "".join(f'<p><a class="x" HREF = "https://{t.upper()}/y">z</a> <a href="/self">s</a>' for t in targets)
        for _ in range(2):
            rows.append((n, f"https://{host}{path}{n}", html))
            n += 1
    edges = {}
    for a, targets in links.items():
        for b in targets:
            edges[a, b] = edges.get((a, b), 0) + 2
    trust, distrust = walk(edges, {"good.com": 1.0}, False), walk(edges, {"bad.net": 1.0}, True)
    found = {r.host: (r.trust, r.distrust) for r in link_trust.host_scores(pages(spark, rows)).collect()}
    own = 1 / (1 - link_trust.DAMPING)  # scores are in units of what a seed has of itself
    for host in links:
        assert found[host] == pytest.approx((own * trust.get(host, 0), own * distrust.get(host, 0)), abs=link_trust.TOLERANCE * link_trust.THRESHOLD)
    for threshold in (0.1, link_trust.THRESHOLD):
        verdicts = {(r.host, r.verdict) for r in link_trust.judge_urls(pages(spark, rows), threshold=threshold).collect()}
        bad = {h for h in links if own * distrust.get(h, 0) > threshold and distrust.get(h, 0) > trust.get(h, 0)}
        assert verdicts == {(h, "block" if h in bad or h == "bad.net" else "allow") for h in links}
    assert "shady.org" in {h for h in links if own * distrust.get(h, 0) > 0.1}


@pytest.mark.parametrize("blocked", [10, 40])
def test_verdicts_do_not_depend_on_how_many_hosts_are_blocked(spark, blocked):
    """Hosts with two of three pages blocked by rule are blocked seeds, and so is their third page, however many they are; so are hosts that link to them alone."""
    rows = [(3 * i + j, f"http://bad{i}.net{path}", None) for i in range(blocked) for j, path in enumerate(("/es/a", "/fr/b", "/en/c"))]
    rows += [(1000 + i, f"http://open{i}.org/", f"<a href='//bad{i}.net'>" if i < 5 else None) for i in range(100 - blocked)]
    found = {r.page_id: r.verdict for r in link_trust.judge_urls(pages(spark, rows)).collect()}
    assert {found[3 * i + 2] for i in range(blocked)} == {"block"}
    assert [found[1000 + i] for i in range(8)] == ["block"] * 5 + ["allow"] * 3
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[-1] for r in connection.execute("SELECT page_id, verdict FROM (" + ORACLE["op5_url_filter"] + ")").fetchall()} == found


def link_farm():
    """Pages of hosts that the rules allow, block or leave open, with links among them; attributes and hosts of any length."""
    rng = random.Random(21)
    wide = {2000: "x" * 1990, 2001: "x" * 2001, 5000: "x" * 5000}
    hosts = [f"good{i}.com" for i in range(4)] + [f"bad{i}.net" for i in range(4)] + [f"open{i}.org" for i in range(24)] + [f"{'h' * n}.org" for n in (250, 256, 300)]
    rows = []

    def page(host, targets, path="/p"):
        tags = [f'<A data-j="{rng.choice(list(wide.values()))}"\n  HREF = "{rng.choice(["https:", "HTTP:", ""])}//{t.title() if rng.random() < 0.3 else t}/q?x">t</a>' for t in targets]
        rows.append((len(rows), f"https://{host}{path}", "<html><a name=x>" + " text ".join(tags) + "<a href='/own'>"))

    for i in range(4):
        page(f"good{i}.com", [f"open{j}.org" for j in range(0, 12, 3)])
        page(f"bad{i}.net", rng.sample(hosts, 3), "/es/")
    for i in range(24):  # the first trust-worthy, all but a few linking to blocked hosts
        page(f"open{i}.org", [f"bad{j}.net" for j in range(4)][: i % 5] + rng.sample(hosts, i % 3))
    for host in hosts[32:35]:
        page(host, ["bad1.net", "bad2.net"])
    page("bad9.net", [], "/es/")
    for i in range(24):
        page(f"chain{i}.io", [f"chain{i - 1}.io" if i else "bad9.net"])
    rows += [(None, None, None), (len(rows), "no host", "<a href=//bad0.net>"), (3, "http://open1.org/again", None)]
    return rows


def test_walks_agree_with_the_sql(spark, monkeypatch, threshold=0.02):
    """Verdicts that the links decide, by distrust and against it by trust, equal those of the SQL in another engine."""
    monkeypatch.setattr(link_trust, "THRESHOLD", threshold)
    rows = link_farm()
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(connection.execute(_url_sql()).fetchall(), key=repr)
    found = link_trust.judge_urls(pages(spark, rows), threshold=threshold)
    assert plain(found, "page_id", "host", "path", "rule", "verdict") == want
    open_ = {h: v for _, h, _, rule, v in want if rule is None}
    assert {"block", "allow"} == set(open_.values())
    scores = {r.host: (r.trust, r.distrust) for r in link_trust.host_scores(pages(spark, rows)).collect()}
    blocked = {h for h, v in open_.items() if v == "block"}
    assert any(d > threshold and t >= d and h not in blocked for h, (t, d) in scores.items())  # saved by trust
    assert all(len(h) < 250 or h in blocked for h in open_) and scores["h" * 256 + ".org"][1] > 0
    assert sum(h.startswith("chain") for h in blocked) > 15  # far from the seed, after many steps


def test_steps_grow_with_the_hosts():
    assert link_trust.rounds_for(10) < link_trust.rounds_for(10**9) < 180


def test_no_pages(spark):
    assert link_trust.judge_urls(pages(spark, [])).count() == 0


def test_only_built_in_functions(spark):
    plan = link_trust.judge_urls(pages(spark, [(1, "http://a.org/", "<a href='//b.org'>")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_links_of_any_length_are_found(spark):
    """As the SQL of the query finds them, however much white space, how many attributes or how long a host; in time that follows the page."""
    wide, host = "\n" + " " * 40, "h" * 300 + ".org"
    html = [
        f'<a href="{wide}https://one.org/x">', f"<a href{wide}={wide}'//two.org'>", f'<a data-x="{"{}" * 3000}" href="//three.org/">', f"<a href=//{host}/>",
        "<a x <a y> <a href='/own'> <A\nHREF=HTTP://Four.org?q> <a b href=//five.org c href='//six.org'> <a href='//seven.org <a href=//eight.org>", "<a href\x0b=//nine.org> <a href=//ten\x0b.org>",
        "<a " * 300_000 + "> <a href=//eleven.org>", "<a href" + " " * 300_000 + "x //y>",
    ]
    link = re.search(r"regexp_extract_all\(html, '(.*?)', 1\)", ORACLE["op5_url_filter"])[1].replace("''", "'")
    for i, page in enumerate(html):
        found = spark.createDataFrame([(page,)], "html string").select(F.array_remove(F.regexp_extract_all("html", F.lit(link_trust.LINK), F.lit(1)), "")).first()[0]
        assert found == duckdb.execute("SELECT regexp_extract_all(?, ?, 1)", [page, link]).fetchone()[0], i
    rows = [(1, "http://a.net/es/", None), *((i + 2, f"http://p{i}.com/", x.replace("one.org", "a.net").replace("two.org", "a.net").replace("three.org", "a.net")) for i, x in enumerate(html[:3]))]
    scores = {r.host: r.distrust for r in link_trust.host_scores(pages(spark, rows)).collect()}
    assert all(scores[f"p{i}.com"] > 0 for i in range(3))
