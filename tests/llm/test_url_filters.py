import re

from changeseries.llm import url_filters as U


def judged(spark, urls, **options):
    rows = spark.createDataFrame([(i, u, "a", "b") for i, u in urls], "page_id long, url string, host string, pattern string")
    return sorted(([*r] for r in U.filter_urls(rows, **options).collect()), key=repr)


def brute(urls, path_rules=U.PATH_RULES, pattern_rules=U.PATTERN_RULES):
    """Every rule against every url."""
    out = []
    for identity, url in urls:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in path_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            rule = max(fits, key=lambda r: (len(r.text), len(r.host)))
            out.append([identity, host, path, rule.text, rule.verdict, None])
            continue
        lowered = "".join(c.lower() if c.isascii() else c for c in url or "")
        hits = [(U.compile_pattern(p)[1], p) for p in pattern_rules if re.search(U.compile_pattern(p)[0], lowered)]
        allowing = [p for exception, p in hits if exception]
        verdict = "block" if hits and not allowing else "allow"
        out.append([identity, host, path, None, verdict, min(allowing or [p for _, p in hits], default=None)])
    return sorted(out, key=repr)


URLS = [
    "http://a.net/x", "http://net/", "http://a.net", "http://a.net?x", "https://EXAMPLE.net/en/1", "http://www.example.net/en/", "http://xexample.net/en/",
    "http://example.com/de/1", "http://example.com/de", "http://example.org/fr/2#x", "http://org/fr/", "ftp://b.org/fr", "no scheme", "", None, "://", "http://",
    "http://a.b://c.net/d", "http://spam-farm.example.org/en/1", "http://x.spam-farm.example.org/", "http://notspam-farm.example.org/", "http://a.com/?u=||spam-farm.",
    "http://doubleclick.x.com/ads?x", "http://a.com/casino/1", "http://help.a.com/casino/1", "http://a.com/CASINO/", "http://a.com/cgi-bin/a/b.cgi", "http://a.com/cgi-bin/a.cgi?x",
    "http://a.com/x?sessionid=3", "http://a.com/xsessionid=3", "http://a.com/file.exe?x", "http://a.com/file.exec", "http://a.com/banner1/ads/x", "http://a.com/ads.txt",
    "http://ünï.com/casino/ß", "http://a.com/" + "long/" * 20_000 + "casino/", "http://a.com/\n/casino/",
]


def test_brute_force_and_odd_rows(spark):
    urls = [*enumerate(URLS), (None, "http://a.net/"), (3, "http://spam-farm.x/"), (3, "http://spam-farm.x/"), (3, "http://spam-farm.x/")]
    assert judged(spark, urls) == brute(urls)
    assert judged(spark, []) == []


def test_rules_without_tokens_and_no_rules(spark):
    urls = list(enumerate(URLS))
    rules = ("*", "a*b", "|http://a", "^", "@@/x[0-9]*1/", "||a.com^", ".cgi|", "ads", "/ads^")
    assert judged(spark, urls, pattern_rules=rules) == brute(urls, pattern_rules=rules)
    assert judged(spark, urls, pattern_rules=(), path_rules=()) == brute(urls, (), ())


def test_tokens_must_stand_whole_in_every_match():
    assert U.compile_pattern("||spam-farm.")[2] == ["farm", "spam"]
    assert U.compile_pattern("ads")[2] == []
    assert U.compile_pattern("/ads^")[2] == ["ads"]
    assert U.compile_pattern("/banner*/x|")[2] == ["x"]
    assert U.compile_pattern("|http://a")[2] == ["http"]


def test_rarest_token_files_a_rule(spark):
    tokens = spark.createDataFrame([("com",)] * 5 + [("rare",)], "token string")
    patterns = U.pattern_table(tokens, ("/com/rare/unseen/", "/com/rare/", "*"))
    index = {r.pattern: r.token for r in U.rarest_tokens(tokens, patterns).collect()}
    assert index == {"/com/rare/unseen/": "unseen", "/com/rare/": "rare", "*": ""}
