import random

import pytest

from voxgrain.llm.url_filter import RULES, RuleTrie, judge_urls, split_url

SCHEMA = "page_id long, url string, host string, judged string"
ODD = [None, "", "x", "://", "http://", "HTTP://A.Example.ORG", "http://EXAMPLE.org/es/x?q=/en/1", "http://notexample.org/es/", "http://example.org/es", "http://example.org/en/12#a?b",
       "http://a.b.com/de/", "a://b.com/fr/://c.org/", "http://example.org?x/es/", "http://İ.ORG/"]


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_trie_and_join_against_brute_force(spark, limit):
    rnd = random.Random(4)
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "/x", "/xy", "y", ""]) for _ in range(rnd.randint(0, 4)))
    rules = {}
    for _ in range(40):
        rules.setdefault((host(), rnd.choice(["", "/"]) + path()), rnd.choice(["allow", "block"]))
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = ODD + [f"http://{host()}{path()}{rnd.choice(['', '?a=/x', '#/y'])}" for _ in range(300)]
    for some in (rules, RULES):
        rows = [(i, u, "h", "j") for i, u in enumerate(urls * 2)]
        got = judge_urls(spark.createDataFrame(rows, SCHEMA).repartition(3), some, trie_limit=limit).select("page_id", "judged.*").collect()
        assert sorted(tuple(r) for r in got) == sorted((i, *brute(u, some)) for i, u, *_ in rows)
    assert judge_urls(spark.createDataFrame([], SCHEMA), RULES, trie_limit=limit).collect() == []


def test_rules_must_not_contradict():
    with pytest.raises(ValueError):
        RuleTrie([("allow", "a", "/"), ("block", "A", "/")])
    assert split_url("a://B/c?d") == ("b", "/c")
