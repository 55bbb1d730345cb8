"""The URL models are fitted on every labelled URL."""

import math

import numpy as np

from aislemetrics.llm import url_filter as U
from aislemetrics.llm.queries import ALLOW, BLOCK

URLS = ["http://a.org/b", "http://a.org/bb?x=1", "", "é://\U0001f600/", "http://q.com/de/1"]


def test_hashed_model_is_the_character_model():
    plain, hashed = U.CharModel().fit(URLS), U.HashedModel().fit(URLS)
    texts = [*URLS, "http://a.org/zz", "ftp://new"]
    got = hashed.log_likelihoods(*U.grams(texts))
    assert all(math.isclose(a, plain.log_likelihood(t), abs_tol=1e-4) for a, t in zip(got, texts))


def test_table_gives_what_lists_give(spark):
    rows = [(f"http://h{i}.org/{i * 7}", "allow") for i in range(300)] + [(f"http://g{i}.com/de/{i * 3}", "block") for i in range(200)]
    ratio = U.train_on(spark.createDataFrame(rows, "u string, v string").repartition(3))
    held = {r.u for r in spark.createDataFrame(rows, "u string, v string").filter("pmod(xxhash64(u), 5) = 0").collect()}
    for v, model in (("allow", ratio.accepted), ("block", ratio.rejected)):
        own = U.HashedModel().fit([u for u, k in rows if k == v and u not in held])
        assert np.array_equal(own.n, model.n) and np.array_equal(own.kinds, model.kinds) and model.n.sum() > 0


def test_no_labelled_url_is_left_out(spark, monkeypatch):
    """12,000 URLs of a kind: all of them are counted or calibrate."""
    made, train = [], U.train_on
    monkeypatch.setattr(U, "train_on", lambda labelled: made.append(train(labelled)) or made[0])
    pages = spark.range(12_000).selectExpr("concat('http://x.org/', id) as url").unionByName(spark.range(12_000).selectExpr("concat('http://x.com/de/', id) as url"))
    assert U.judged(pages, ALLOW, BLOCK).count() == 24_000
    place = int(U.grams([""])[0][0][0]) & (U.CONTEXTS - 1)  # the empty context: every character and end counted
    for model, part in ((made[0].accepted, "%.org/%"), (made[0].rejected, "%.com/%")):
        fitted = pages.filter(f"url like '{part}' and pmod(xxhash64(url), 5) <> 0").selectExpr("sum(length(url) + 1)").first()[0]
        assert model.n[place] == fitted > 8000 * 14
