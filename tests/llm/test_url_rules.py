"""URL rules against a scan of all rules."""

import random

import pytest

from fleetspan.llm.url_rules import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SCHEMA = "page_id long, url string, host string, _found int, extra string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def brute(url, rules, default="allow"):
    host, path = split(url)
    best = (-1, -1, None, default)
    for name, start, verdict in rules:
        name, start = (name or "").lower(), start or ""
        below = not name or host == name or host.endswith("." + name)
        labels = name.count(".") + 1 if name else 0
        if below and path.startswith(start) and (labels, len(start), verdict) > (best[0], best[1], best[3] if best[2] is not None else ""):
            best = (labels, len(start), name + start, verdict)
    return host, path, best[2], best[3]


def check(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i if i % 9 else None, url, "clash", 1, "x") for i, url in enumerate(urls)], SCHEMA)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    judged = judge_urls(pages.repartition(3), table, **more)
    assert judged.columns == ["page_id", "host", "path", "rule", "verdict"]
    default = more.get("default", "allow")
    assert sorted(map(repr, map(tuple, judged.collect()))) == sorted(
        repr((i if i % 9 else None, *brute(url, rules, default))) for i, url in enumerate(urls))


FIXED = [
    None, "", "no scheme", "http://", "http://example.org", "http://example.org/", "HTTP://WWW.Example.ORG/es/1", "http://example.org/es",
    "http://example.org/en/12?x#y", "http://example.org/en/2", "http://notexample.org/es/", "http://a.example.org:80/es/", "x://y.com/de/z",
    "http://y.com/fr/http://z.org/es/", "http://com/de/", "http://com./de/", "http://.com/de/", "http://ÄB.com/FR/", "http://q.org?/es/", "http://q.org#/x",
    "http://q.com/de/\n/x", "http://a\nb.com/de/1", "http://example.org//es/", "://example.org/es/", "http://a.com/de/" + "s/" * 50_000, "http://" + "a." * 5_000 + "com/de/",
]


def test_contract_rules(spark):
    check(spark, FIXED + FIXED[:9], RULES)


def test_many_rules_in_one_trie_and_in_blocks(spark):
    draw = random.Random(5)
    host = lambda: ".".join(draw.choice(["a", "b", "com", "org"]) for _ in range(draw.randrange(1, 4)))
    path = lambda: "".join(draw.choice(["/", "/a", "b", "/ab", "/a/"]) for _ in range(draw.randrange(4)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(150)] + [("", "/ab", "block"), (None, None, "block"), ("A.b", "/a", "allow")]
    urls = [f"s://{host()}{path()}" for _ in range(400)]
    check(spark, urls, rules)
    check(spark, urls, rules, trie_bytes=20_000, default="block")


def test_no_rules_no_pages_and_bad_rules(spark):
    check(spark, FIXED[:6], [], default="block")
    check(spark, [], RULES)
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    with pytest.raises(Exception, match="unknown verdict"):
        judge_urls(pages, spark.createDataFrame([("b", "/", "maybe")], "host string, path string, verdict string")).collect()
    with pytest.raises(ValueError, match="clash"):
        judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), keep=["rule"])
