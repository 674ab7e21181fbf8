import re

from tallymast.llm import urls


def plain(url):
    """(host, path, rule, verdict) from the definition, trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for block, site, start in ((0, "org", "/"), (1, "example.org", "/es/"), (1, "example.org", "/en/1"), (0, "com", "/fr/"), (1, "com", "/de/")):
        if ("." + host).endswith("." + site) and path.startswith(start) and (best is None or len(site + start) > len(best[0])):
            best = site + start, block
    if best:
        return host, path, best[0], "block" if best[1] else "allow"
    bad = any(re.search(rf"(^|[.-]){r.name}([.-]|$)", host) for r in urls.WORDS)
    return host, path, None, "block" if bad else "allow"


def test_rules_against_trying_all(spark):
    hosts = ["example.org", "www.example.org", "myexample.org", "EXAMPLE.ORG", "a.com", "com", "org", "x.net", "www.cheap-pills.x.net", "adsense.net", "ads.net", "exa mple.org", "com.x.net", "casino.example.com", ""]
    paths = ["", "/", "/es/1", "/en/1", "/en/18", "/en/2", "/fr/", "/fr", "/de/x?y#z", "?/es/", "#/de/", "/es/://a.org/", "/DE/1"]
    texts = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c.org/"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string").selectExpr("*", "'x' host", "'y' verdict")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(df).collect()}
    for i, url in enumerate(texts):
        assert got[i] == plain(url), url


def test_a_rule_lies_under_its_rarest_token(spark):
    df = spark.createDataFrame([("http://a.example.org/en/1",), ("http://b.org/en/2",), (None,)], "url string")
    index = urls.index(df, urls.SITES)
    assert [r.name for r in index["example"]] == ["example.org/en/1"] and "es" in index
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
