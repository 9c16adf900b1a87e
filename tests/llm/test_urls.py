"""URL parts, rules and model verdicts against plain Python."""

import re

from pyspark.sql import functions as F

from cipherledger.llm import registry, urls

SF = "/root/testdata/sf0.001"


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    best = None
    for r, _ in urls.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(r) > len(best or ""):
            best = r
    return best


CASES = [None, "", "no-scheme.net/x", "http://a.NET/x", "http://a.net", "http://net/", "HTTP://ÄB.Example.NET/en/1?u=http://q.org/fr/", "https://example.net/EN/",
         "http://notexample.net/en/2", "http://x.example.com/de/", "http://example.com/de", "ftp://sub.a.org/fr/x#y", "http://org/fr/", "http://h?x", "http://h#/net/",
         "http://u@h.org:80/fr/a", "://net/", "http://spam-farm.example.org/en/3", "http://casino-win.example.org/en/4", "http://library.example.org/en/5",
         "http://museum.example.org/en/6", "http://a\nb.net/x\ny", "http://" + "w" * 5000 + ".org/" + "p/" * 5000]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES + CASES[:5])], "page_id int, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urls.judge(df, urls.labelled_table(spark)).collect()}
    assert len(got) == len(CASES) + 5
    said = dict(urls.RULES)
    for i, u in enumerate(CASES):
        r = got[i]
        assert (r.host, r.path, r.rule) == (*parts(u), rule(*parts(u)))
        assert r.verdict == (said[r.rule] if r.rule else "block" if r.score >= .5 else "allow")
    assert [got[i].verdict for i in (17, 18, 19, 20)] == ["block", "block", "allow", "allow"]
    assert urls.judge(df.limit(0), urls.labelled_table(spark)).collect() == []


def test_model_separates_unseen_urls(spark):
    rows = [(f"http://{sub}.{h}.example.{t}/{p}", y) for h, y in (("grand-casino", 1), ("pills-farm", 1), ("spam-ads", 1), ("gardens", 0), ("weatherman", 0), ("stationery", 0))
            for sub in ("www", "news") for t in ("org", "com") for p in ("en/771", "es/2.html", "fr/77/")]
    df = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "page_id int, url string, y int")
    out = urls.judge(df, urls.labelled_table(spark), rules=()).join(df.select("page_id", "y"), "page_id").collect()
    assert sum((r.verdict == "block") == bool(r.y) for r in out) >= .95 * len(out)


def test_fit_without_both_labels(spark):
    weights, intercept = urls.fit(spark.createDataFrame([("http://a.org/", 1), (None, 0)], "url string, label int"))
    assert not any(weights) and intercept < 0


def test_registered_query_on_hosts_outside_the_table(spark):
    """Every page, by the rules where one fits; elsewhere hosts that say what they are."""
    pages = registry.table(spark, SF, "pages").select("page_id", "url").collect()
    got = {r.page_id: r for r in registry.QUERIES["op7_url_filter"](spark, SF).collect()}
    assert len(got) == len(pages)
    said, known = dict(urls.RULES), {parts(u)[0].split(".")[-3] for u, _ in urls.LABELLED}
    right = []
    for p in pages:
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (*parts(p.url), rule(*parts(p.url)))
        assert r.verdict == (said[r.rule] if r.rule else "block" if r.score >= .5 else "allow")
        assert not {name for name in r.host.split(".")} & known
        if not r.rule:
            unwanted = any(w in r.host for w in ("casino", "pills", "spam", "ads", "adult"))
            right.append((r.verdict == "block") == unwanted)
    assert len(right) > 20 and sum(right) >= .9 * len(right)
