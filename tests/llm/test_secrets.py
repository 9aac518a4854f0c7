import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxgrain.llm.secrets import RULES, Rule, find_secrets, op13_secret_scan
from voxgrain.llm.trigrams import ALL, trigram_query

PATTERNS = [r.pattern for r in RULES] + [
    "abc", "ab", "abcd?e", "(abc|xyz)+q", "x(foo|bar)y", "[ab]cd[ef]", "foo.*bar", "(a|b|)cde", "^abc$", "(?:abc){2,3}", "a{3}", "[^a]bcd", "(abcd|ab)", "(foo){0,2}bar", "\\bkey\\b", "é+abc", "[a-z]xyz", "ab(?=cd)cde", "Abc[0-9]Q",
]


def holds(query, text):
    return any(all(t in text.lower() for t in a) for a in query)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_text_that_matches_holds_the_trigrams(pattern):
    rnd, query, matched = random.Random(3), trigram_query(pattern), 0
    bits = [*re.findall(r"[A-Za-z_]+", pattern), *"abcdefxyzq :=_é", "password", "PASSWD", "api_key", "apikey", "token", "secret", "AKIA", "0123456789abcdef0123456789abcdef", "ABCDEFGHIJKLMNOP", "aaa", "abcabc", "Abc7Q", "foobar", "key", "bcd", "cde", "éabc"]
    for _ in range(4000):
        text = "".join(rnd.choices(bits, k=rnd.randrange(1, 6)))
        if re.search(pattern, text):
            matched += 1
            assert holds(query, text), text
    assert matched


@settings(max_examples=200, deadline=None)
@given(st.from_regex(RULES[0].pattern))
def test_whatever_the_rule_matches_holds_its_trigrams(text):
    assert holds(trigram_query(RULES[0].pattern), text)


def test_queries():
    assert trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert trigram_query("(secret|token)") == frozenset([frozenset(["sec", "ecr", "cre", "ret"]), frozenset(["tok", "oke", "ken"])])
    assert trigram_query("x[ab]cd") == frozenset([frozenset(["xac", "acd"]), frozenset(["xbc", "bcd"])])
    assert trigram_query("a.c") == trigram_query("[0-9a-f]{32}") == trigram_query("(abc)*") == trigram_query("abc|") == ALL
    assert trigram_query("abc.def") == frozenset([frozenset(["abc", "def"])])


BASE = {"assign": (re.compile(RULES[0].pattern), 2, 8), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}


def brute(text):
    """The contract, read literally: every match of the base pattern, then those that are long enough."""
    out = []
    for k, (pattern, group, least) in enumerate(BASE.values()):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def texts():
    rnd = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey", "=", ":", " ", "  ", '"', "'", "abcdefgh", "x.y/z+1-", "AKIA", "ABCDEFGHIJKL", "AKIAAKIA", "0123456789abcdef", "0123456789abcdef" * 2, "\n", "é", "𝔘", "Key", "K", "ſecret"]
    for _ in range(400):
        yield "".join(rnd.choices(bits, k=rnd.randrange(30)))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    many = "token=abcdefgh1 " * 5000
    rows = [None, "", " ", "secret=token:abcdefghij", "é𝔘 password: 'hunter2hunter2'", "password" + " " * 100_000, many, "f" * 300_000, *texts()]
    data = [(i // 2 if i % 7 else None, t, "src", "x", 1, 2) for i, t in enumerate([*rows, many])]
    schema = "doc_id long, text string, source string, file string, word int, maybe_0 int"
    path = str(tmp_path_factory.mktemp("secrets"))
    spark.createDataFrame(data, schema).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path, data


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_spans_against_brute_force(spark, table, limit):
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    found = sorted((repr(r.doc_id), [tuple(s) for s in r.spans]) for r in find_secrets(docs, broadcast_words=limit).collect())
    assert found == sorted((repr(d[0]), brute(d[1])) for d in table[1])


def test_query_against_brute_force(spark, table):
    rows = op13_secret_scan(spark, table[0]).collect()
    said = lambda spans: ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans)
    want = sorted((repr(d[0]), said(brute(d[1]))) for d in table[1])
    assert sorted((repr(r.doc_id), r.spans) for r in rows) == want
    assert all((r.n_assign, r.n_access, r.n_hex) == tuple(r.spans.count(k.kind + ":") for k in RULES) for r in rows)


def test_other_rules_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a foo1 b foo22"), (2, "bar")], "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in find_secrets(docs, [Rule("n", "fo+([0-9]+)", 1, 2), Rule("bar", "bar")]).collect()}
    assert found == {1: [(9, 0, 14)], 2: [(0, 1, 3)]}
    assert find_secrets(docs.limit(0)).count() == 0
    assert [r.spans for r in find_secrets(docs, [Rule("any", "[a-c]{3}")]).orderBy("doc_id").collect()] == [[], []]
