"""The automaton against regular expressions, and the operator on odd rows."""

import random
import re

import pytest

from logweave.llm.url_filters import DEFAULTS, RULES, Automaton, Rule, canonical, host_rule, judge


def plain(glob):
    return re.compile(b"".join(b".*" if c == 0x2A else b"." if c == 0x3F else re.escape(bytes([c])) for c in glob), re.DOTALL)


@pytest.mark.parametrize("n_globs", [1, 7, 60, 150])
def test_many_globs_against_regular_expressions(n_globs):
    """Short alphabets, so that globs of several words often fit; stars at both ends, in rows, and alone."""
    rng = random.Random(n_globs)
    word = lambda low, high, letters: "".join(rng.choice(letters) for _ in range(rng.randrange(low, high))).encode()
    globs = [word(0, 9, "ab*?./") for _ in range(n_globs - 1)] + [b"*" + word(70, 80, "ab") + b"*"]
    urls = [word(0, 14, "ab./") for _ in range(300)] + [b"", b"x" + globs[-1][1:-1] + b"y", word(3000, 3001, "ab./")]
    wanted = [plain(g) for g in globs]
    got = Automaton(globs).matches(urls)
    assert got.tolist() == [[w.fullmatch(u) is not None for w in wanted] for u in urls]
    assert got.any() and got[301, -1]


URLS = [
    (1, "http://a.example.NET/en/x?q", ("a.example.net", "/en/x", "example.net/en/", "allow")),
    (2, "http://example.net/EN/", ("example.net", "/EN/", "net/", "block")),
    (3, "http://badexample.com/de/", ("badexample.com", "/de/", None, "allow")),
    (4, "http://net", ("net", "", None, "allow")),
    (5, "http://x.org/ads/1", ("x.org", "/ads/1", None, "block")),
    (6, "http://x.org/fr/ads/1", ("x.org", "/fr/ads/1", "org/fr/", "allow")),
    (7, "no mark", ("", "", None, "allow")),
    (8, "", ("", "", None, "allow")),
    (9, None, ("", "", None, "allow")),
    (10, "http://cheap-x.fr#/ads/", ("cheap-x.fr", "", None, "block")),
    (11, "http://é.com/" + "a" * 50_000 + "/ads/", ("é.com", "/" + "a" * 50_000 + "/ads/", None, "block")),
]


def test_odd_rows(spark):
    """Nulls, empty and very long URLs, repeated rows, and columns with the operator's own names."""
    rows = [(n, u, "h", "r", "v") for n, u, _ in [*URLS, URLS[0], URLS[8]]] + [(None, URLS[1][1], None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string, verdict string")
    want = [(n, *w) for n, _, w in [*URLS, URLS[0], URLS[8]]] + [(None, *URLS[1][2])]
    got = [tuple(r) for r in judge(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert judge(df.limit(0)).columns == ["page_id", "host", "path", "rule", "verdict"] and judge(df.limit(0)).count() == 0


def test_longest_name_then_first(spark):
    rules = (host_rule("block", "a.b/"), host_rule("allow", "b/xx"), Rule("same", b"*", "block"), Rule("else", b"*", "allow"))
    df = spark.createDataFrame([(1, "http://a.b/xx"), (2, "http://c.b/xx"), (3, "http://c.c/")], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge(df, rules=rules, defaults=()).collect()}
    assert got == {1: ("a.b/", "block"), 2: ("b/xx", "allow"), 3: ("same", "block")}
    assert canonical("http://A?b")[:2] == ("a", "") and len(RULES) == 4 and all(r.name is None for r in DEFAULTS)
