import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlake.llm import entries, mixing, scratch, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        docs = scratch.materialize(f(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def pairs(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text").collect())


def test_each_stage_against_plain_python(spark, stages):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert all(s.columns == documents.columns for s in stages[:4])
    rejected = {r["doc_id"] for r in toxicity.score(documents, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert pairs(stages[0]) == [p for p in pairs(documents) if p[0] not in rejected]
    kept = {d for d, _, _, k in brute.near(pairs(stages[0]), 5) if k}
    assert pairs(stages[1]) == [p for p in pairs(stages[0]) if p[0] in kept]
    dirty = {r[0] for r in brute.decontaminate(pairs(stages[1]), bench) if r[5]}
    assert dirty and pairs(stages[2]) == [p for p in pairs(stages[1]) if p[0] not in dirty]
    times = {r["doc_id"]: r["times"] for r in mixing.plan(stages[2]).collect()}
    assert pairs(stages[3]) == sorted(p for p in pairs(stages[2]) for _ in range(times[p[0]]))
    want = brute.tokens(pairs(stages[3]), Tokenizer.from_file(public_tokenizers.path(entries.TOKENIZER)))
    assert sorted(tuple(r) for r in stages[4].select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_run_is_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[4].collect()))


def test_odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns, and no rows at all."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    made = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, None, None), (None, "one two three four five six", "en", "s"), (3, None, "en", "s"), (4, "", None, None), (5, "w " * 300_000 + "end", "en", "t"), (6, "six " + text[::-1], "en", "t"), (6, "another text of document six", "en", "t")]
    odd = spark.createDataFrame([(*r, 1, "x", 2.0) for r in made], "doc_id long, text string, lang string, source string, n_chars int, size string, target double")
    for rows in (odd, odd.limit(0)):
        docs, seen = rows, []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = scratch.materialize(stage(spark, docs, SF), "odd")
            if k < 4:
                assert docs.columns == odd.columns
            seen.append(sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str))
        if rows is odd:
            assert seen[1] == [1, 3, 4, 5, 6, 6, None] and seen[2] == seen[1]
            assert set(seen[3]) <= {1, 5, 6, None} and len(seen[3]) == len(seen[4])
            plan = mixing.plan(odd.where("doc_id is null or doc_id in (5, 6)"))
            assert plan.where("times = 0 and size = 0").count() == 0
        else:
            assert seen == [[]] * 5
