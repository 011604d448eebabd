import pytest

import corpus_pipeline
from tablejury.llm.catalog import QUERIES
from tests.llm import test_near_dedup, test_packing, test_pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_each_stage_on_its_own_input(spark, stages):
    frames = [{r.doc_id: r for r in d.collect()} for _, d in stages[:-1]]
    documents, good, distinct, private = frames
    assert [n for n, _ in stages[1:]] == ["quality", "near-dedup", "pii", "packing"]
    assert all(d.columns == stages[0][1].columns for _, d in stages[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(good[i] == documents[i] for i in good) and len(good) < len(documents)
    assert sum(i in good for i, q in labels.items() if q == 1) >= 0.95 * sum(q == 1 for q in labels.values())
    kept = {i for i, _, _, keep in test_near_dedup.brute([(r.doc_id, r.text) for r in good.values()]) if keep}
    assert set(distinct) == kept and all(distinct[i] == good[i] for i in distinct)
    assert set(private) == set(distinct)
    for i, r in private.items():
        if not test_pii.brute(distinct[i].text):
            assert r == distinct[i]
        assert not test_pii.brute(r.text) and r.n_chars == len(r.text)
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(test_packing.public_tokenizers.path("byte_bpe_50k.json"))
    test_packing.check(stages[-1][1].collect(), [(r.doc_id, r.text) for r in private.values()], reference, 2048)


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


def test_every_operator_has_its_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
