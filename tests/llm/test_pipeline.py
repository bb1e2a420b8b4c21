import pytest
from pyspark.sql import functions as F

from gradeweave.llm import jaccard, mixing, quality, secrets

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, at[-1], SF).write.parquet(f"{tmp_path}/{k}")
        at.append(spark.read.parquet(f"{tmp_path}/{k}"))
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in at]
    assert ids[1] == {r.doc_id for r in quality.decide(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").collect()}
    linked = jaccard.link(at[1], 5, 80)
    assert ids[2] == {r.component_id for r in linked.collect()} and at[2].count() == len(ids[2])
    assert ids[3] == ids[2] and at[3].columns == docs.columns
    assert secrets.scan(at[3], secrets.BASE).where("size(spans) > 0").count() == 0
    assert at[4].count() == mixing.schedule(at[3]).agg(F.sum("copies")).first()[0]
    assert at[5].count() == at[4].count()
    assert at[5].join(at[4].select("doc_id", F.sha2("text", 256).alias("h")).distinct(), "doc_id").where("h <> decoded_sha256").count() == 0


def test_empty_and_null_rows(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for some in (docs.limit(0), docs.limit(3).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))):
        out = some
        for _, stage in P.STAGES:
            out = stage(spark, out, SF)
        assert out.count() == 0


def test_near_duplicates_with_repeated_keys(spark):
    import corpus_pipeline as P

    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [
        (1, one), (2, one + " tail"), (2, two), (2, two),  # the first text of 2 is a copy of 1's, the second is not
        (3, three), (3, three + " tail"),  # near copies under one key: one stays
        (None, one), (None, one), (4, None), (4, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in P.near_duplicates(spark, docs, SF).collect()]
    assert len([r for r in got if r[0] == 3]) == 1
    assert sorted(r for r in got if r[0] in (1, 2)) == [(1, one), (2, two)]
    assert len(got) == 7 and got.count((None, one)) == 2 and (4, None) in got and (4, "") in got
