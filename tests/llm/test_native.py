import hashlib
import random
from collections import Counter, defaultdict

from linkwright.llm.exact_dedup import exact_dedup, exact_groups
from linkwright.llm.mixing import mix
from linkwright.llm.url_filter import Rule, judge

DOCS = "doc_id long, text string, keep_id string, h int, source string"


def test_exact_dedup(spark):
    rows = [(i, f"text {i % 7}" if i % 5 else None, "x", i, "s") for i in range(40)] + [(100 + i, "hot", "x", 0, "s") for i in range(60)]
    rows += [(200, "", "x", 0, "s"), (3, "text 3", "y", 1, "s"), (3, "text 3", "y", 1, "s"), (None, "alone", "x", 0, "s"), (None, "hot", "x", 0, "s"), (300, "long " * 30000, "x", 0, "s")]
    docs = spark.createDataFrame(rows, DOCS)
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_groups(docs, keep=keep, hot_rows=20, salts=4).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(by)
        for r in got:
            t = r["row"]["text"] or ""
            ids = [i for i in by[t] if i is not None]
            assert r["keep_id"] == best(ids, default=None) and r["group_size"] == len(by[t]) and r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup(docs).columns == docs.columns
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, "k", 0, None), (None, "a b", "k", 0, "s"), (2, "", "k", 0, "t"), (3, "a " * 100, "k", 0, "s"), (3, "a " * 100, "k", 0, "s")], DOCS)
    # s (201 words, weight 5) and t (none, weight 2): s has the whole budget; null texts and sizes of 0 weigh nothing
    made = mix(docs)
    assert made.columns == docs.columns
    times = Counter((r["doc_id"], r["source"]) for r in made.collect())
    words = sum(n * {(None, "s"): 2, (3, "s"): 100}.get(k, 0) for k, n in times.items())
    assert 150 <= words <= 252 and times[3, "s"] % 2 == 0 and all(n <= 3 * (2 if k == (3, "s") else 1) for k, n in times.items())
    assert Counter((r["doc_id"], r["source"]) for r in mix(docs).collect()) == times
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def ranks_by_hand(links, seeds, total):
    """PageRank over dictionaries until nothing moves."""
    out, rank = defaultdict(int), {}
    for (a, _), n in links.items():
        out[a] += n
    for _ in range(300):
        new = defaultdict(float, {h: 0.15 * m / total for h, m in seeds.items()})
        for (a, b), n in links.items():
            new[b] += 0.85 * rank.get(a, 0.0) * n / out[a]
        rank = new
    return rank


def test_pagerank_by_hand(spark):
    """A graph with chains of forty hosts, cycles and a hub; every page's trust, distrust and verdict."""
    rng = random.Random(3)
    hosts = [f"h{k}.net" for k in range(60)]
    pages, links, seeds = [], Counter(), {"allow": Counter(), "block": Counter()}
    for k, h in enumerate(hosts):
        to = [hosts[k + 1]] if k < 40 else rng.choices(hosts, k=4) + ["h0.net"]
        pages.append((k, f"https://{h}/p", " ".join(f'<a href="http://user@{t.upper()}:80/x">' for t in to), 0))
        links.update((h, t) for t in to if t != h)
    for k, (host, verdict) in enumerate([("good.org", "allow"), ("bad.com", "block"), ("bad.com", "block"), ("h30.net", "allow"), ("h50.net", "block")]):
        path, to = ("/ok" if verdict == "allow" else "/no"), rng.choice(hosts)
        pages.append((100 + k, f"http://{host}{path}", f"<img src='//{to}/i.png'>", 0))
        seeds[verdict][host] += 1
        links.update([(host, to)] if to != host else [])
    rules = [Rule(h, p, v) for h in ("org", "com", "net") for p, v in (("/ok", "allow"), ("/no", "block"))]
    trust = ranks_by_hand(links, seeds["allow"], 5)
    against = ranks_by_hand({(b, a): n for (a, b), n in links.items()}, seeds["block"], 5)
    for r in judge(spark.createDataFrame(pages, "page_id long, url string, html string, trust int"), rules).collect():
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 1e-3 and abs(r["distrust"] - against.get(r["host"], 0)) < 1e-3
        if r["rule"] is None and abs(trust.get(r["host"], 0) - against.get(r["host"], 0)) > 2e-3:
            assert r["verdict"] == ("block" if against.get(r["host"], 0) > trust.get(r["host"], 0) else "allow")
    assert trust["h39.net"] > 0


def test_rules_of_equal_length_and_long_pages(spark):
    rules = [Rule("org", "/a", "allow"), Rule("org", "/a", "block"), Rule("x.org", "/", "allow")]
    rows = [(1, "http://y.org/a", None), (2, "http://x.org/a", None), (3, "http://y.org/" + "a" * 200_000, "<p>" * 300_000), (4, "", ""), (5, "://", "")]
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("y.org", "org/a", "block"), 2: ("x.org", "x.org/", "allow"), 3: ("y.org", "org/a", "block"), 4: ("", None, "allow"), 5: ("", None, "allow")}


def test_urls(spark):
    rules = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("com", "/de/", "block")]
    link = '<a href="https://bad.com/x">'
    rows = [(1, "http://A.Example.ORG/es/1?q#f", None, 1), (2, "http://notexample.org/es/", "", 1), (3, None, "", 1), (4, "no scheme", "", 1), (5, "http://bad.com/de/", "", 1), (6, "http://friend.net/x", link, 1), (7, "http://plain.net?x=/de/", "", 1), (7, "http://plain.net?x=/de/", "", 1), (8, "http://bad.com/en", "", 1)]
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string, trust int"), rules).collect()]
    assert sorted(got) == [
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "notexample.org", "/es/", "org/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "bad.com", "/de/", "com/de/", "block"),
        (6, "friend.net", "/x", None, "block"), (7, "plain.net", "", None, "allow"), (7, "plain.net", "", None, "allow"), (8, "bad.com", "/en", None, "block"),
    ]
    assert judge(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0
