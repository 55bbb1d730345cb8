import math
import re

import pytest
from pyspark.sql import functions as F

from aislemetrics.llm import url_filter as U
from aislemetrics.llm.common import LOWER, UPPER, table
from aislemetrics.llm.queries import ALLOW, BLOCK, QUERIES

URLS = [
    None, "", "example.org/es/1", "http://Blog.EXAMPLE.org/es/12?x=1", "https://example.org/en/1", "https://a.example.org/en/19#t", "https://notexample.org/es/",
    "http://org", "http://org/", "http://x.org?y", "http://x.com/fr/1", "http://x.com/fr", "http://com/de/", "http://x.com/de/9", "http://x.com/DE/9", "http://x.net/de/",
    "ftp://a.org:80/en/1", "http://x.com?u=http://y.org/es/", "://q.com/fr/", "http://x.orgs/", "http://x.com/fr/\nnew", "a b://x.com/de/1",
]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m.group(1).translate(str.maketrans(UPPER, LOWER)), m.group(2)) if m else ("", "")


def rule_of(host, path):
    fit = []
    for r in [*ALLOW, *BLOCK]:
        d, _, p = r.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p):
            fit.append(r)
    return max(fit, key=len, default=None)


def check(rows):
    for r in rows:
        host, path = split(r.url)
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        if rule:
            assert r.verdict == ("allow" if rule in ALLOW else "block")
        else:
            assert r.verdict == ("allow" if r.p_allow >= 0.5 else "block")


def test_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *URLS])], "page_id int, url string")
    check(U.judged(pages, ALLOW, BLOCK).collect())


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    pages = table(spark, folder, "pages").select("page_id", "url")
    got = QUERIES["op3_url_language_model"](spark, folder)
    assert got.count() == pages.count()
    check(got.join(pages, "page_id").collect())


def test_model_tells_held_out_urls_apart(spark):
    rows = table(spark, "/root/testdata/sf0.1", "pages").select("url").distinct().collect()
    by = {"allow": [], "block": []}
    for r in sorted(x.url for x in rows):
        rule = rule_of(*split(r))
        if rule:
            by["allow" if rule in ALLOW else "block"].append(r)
    model = U.train(by["allow"][::2], by["block"][::2])
    hits = [model.probability(model.figure(u)) >= 0.5 for u in by["allow"][1::2]] + [model.probability(model.figure(u)) < 0.5 for u in by["block"][1::2]]
    assert sum(hits) / len(hits) > 0.93


def test_probabilities_sum_to_one():
    model = U.CharModel(order=2, alphabet=5).fit(["abcab", "abd", ""])
    for context in ("", "\x02\x02", "ab", "zz", "za"):
        letters = ["a", "b", "c", "d", "\x03"]
        assert math.isclose(sum(model.probability(context, c) for c in letters), 1.0, abs_tol=1e-9)


@pytest.mark.parametrize("urls,verdict", [(["http://a.org/x", "http://q.net/"], "allow"), (["http://a.com/de/x", "http://q.net/"], "block"), (["http://q.net/"], "allow")])
def test_one_kind_of_labels(spark, urls, verdict):
    got = U.judged(spark.createDataFrame([(u,) for u in urls], "url string"), ALLOW, BLOCK).filter(F.col("rule").isNull()).collect()
    assert [r.verdict for r in got] == [verdict]


def test_empty_table_and_clashing_names(spark):
    pages = spark.createDataFrame([("http://a.org/", "x", 1)], "url string, host string, figure int")
    assert U.judged(pages, ALLOW, BLOCK).collect()[0].host == "a.org"
    assert U.judged(pages.limit(0), ALLOW, BLOCK).count() == 0
