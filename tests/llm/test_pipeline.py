import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from aislemetrics.llm import bpe, quality
from aislemetrics.llm.common import LOWER, UPPER, crc_mod, table
from tests.llm import test_decontaminate, test_near_dedup

FOLDER = "/root/testdata/sf0.01"


def low(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r.doc_id: r.text for r in docs.collect()}, after.collect())
        assert name == "bpe" or after.columns == columns
        docs = after

    given, kept = seen["quality"]
    model = quality.fit(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"), crc_mod(F.col("id"), 4) != 2)
    pool = quality.Pool(model.context)
    score = {k: float(model.network.score(np.stack([pool(t)]))[0]) for k, t in given.items()}
    assert {r.doc_id for r in kept} == {k for k, s in score.items() if s >= C.ACCEPT}
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    ids = {r.doc_id for r in kept}
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in ids for k in good) >= 0.99 * len(good)

    given, kept = seen["exact_dedup"]
    best = {}
    for k, t in given.items():
        best[low(t)] = max(best.get(low(t), k), k)
    assert {r.doc_id for r in kept} == set(best.values())

    given, kept = seen["near_dedup"]
    want = {k for k, _, root in test_near_dedup.brute(list(given.items()), 5, 80) if k == root}
    assert {r.doc_id for r in kept} == want

    given, kept = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    gone = {k: given[k] for k in set(given) - {r.doc_id for r in kept}}
    held = dict([(r.doc_id, r.text) for r in kept][:60])
    found = test_decontaminate.brute([*gone.items(), *held.items()], items)
    assert {k for k, _ in found} == set(gone) and gone
    assert not any(q in r.text for r in kept for _, q in items)

    given, kept = seen["bpe"]
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in kept:
        ids = library.encode_ordinary(given[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(given[r.doc_id].encode()).hexdigest()
    assert {r.doc_id for r in kept} == set(given)


def test_run(spark):
    got = C.run(spark, "/root/testdata/sf0.001").collect()
    assert got and len({r.doc_id for r in got}) == len(got) and {len(r.ids_sha256) for r in got} == {64}


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_and_empty_table(spark, stage):
    rows = [(1, None, None, 3), (1, None, "fr", 3), (None, "Some words here to keep, and more of them.", "de", None), (2, "", "x", 0), (3, "word " * 30_000, "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int").selectExpr("*", "'s' as source", "1 as hash", "2 as component_id")
    got = C.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert got.count() <= len(rows) and (stage == 4 or got.columns == docs.columns)
    assert C.STAGES[stage][1](spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
