"""URL rules against a linear scan of the rules."""

import itertools
import re

import pytest

from riskloom.llm import url_rules
from riskloom.llm.queries import RULES


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


RULES2 = [*RULES, url_rules.Rule("block", "a.b.c/x/y"), url_rules.Rule("allow", "b.c/x/y/z/"), url_rules.Rule("block", "c/x"),
          url_rules.Rule("allow", "c/x/"), url_rules.Rule("block", "net/")]
HOSTS = ["example.org", "EXAMPLE.org", "www.example.org", "notexample.org", "org", "a.com", "com", "a.b.c", "z.a.b.c", "b.c", "", "x.org.",
         "É.org", "h.net:80", "net"]
PATHS = ["", "/", "/es/1", "/es", "/en/1", "/en/12/x", "/en/2", "/fr/", "/fr", "/de/9?x=/fr/", "/x", "/xx", "/x/y", "/x/y/z/", "/x/yy", "#/es/",
         "?a://b", "//x", "/x//y"]
URLS = [f"http://{h}{p}" for h, p in itertools.product(HOSTS, PATHS)] + [None, "", "org/", "://", "a\nb://Q\nr.org/es/\nx", "http:/x.org/"]


@pytest.mark.parametrize("rules", [RULES, RULES2, []])
def test_rules(spark, rules):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, None, None)]
    got = url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), rules).collect()
    want = [(i, *brute(u, rules)) for i, u, _ in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_and_bounds(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(empty, RULES).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge_urls(empty, RULES, max_rules=2)
    with pytest.raises(ValueError):
        url_rules.build_trie([RULES[0], RULES[0]])
