"""The pipeline's stages on the smallest tables, each judged on its own input."""

import pytest

from tests.llm.plain import plain_groups

pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as cp
    from lodestone.llm import pii, toxicity
    from lodestone.llm.shared import materialize, table

    docs = table(spark, FOLDER, "documents")
    model = toxicity.trained(spark, FOLDER)
    bad = {r["doc_id"] for r in docs.collect() if model.score(r["text"]) >= toxicity.THRESHOLD}
    one = materialize(cp.reject_toxic(spark, docs, FOLDER))
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    two = materialize(cp.drop_site_boilerplate(spark, one, FOLDER))
    assert two.count() == one.count() and two.columns == docs.columns
    three = materialize(cp.keep_one_of_each_group(spark, two, FOLDER))
    left = sorted(two.collect(), key=lambda r: r["doc_id"])
    firsts = {left[g[0]]["doc_id"] for g in plain_groups([r["text"] for r in left])}
    assert {r["doc_id"] for r in three.collect()} == firsts
    four = materialize(cp.redact_personal_data(spark, three, FOLDER))
    field = pii.trained(spark, FOLDER)
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        base, more = pii.find_all([before[r["doc_id"]]], field)[0]
        assert r["text"] == pii.redacted(before[r["doc_id"]], base + more) and r["n_chars"] == len(r["text"])
    five = cp.pack_sequences(spark, four, FOLDER).toPandas()
    assert set(five["doc_id"]) == {r["doc_id"] for r in four.collect()}
    assert five.groupby("sequence_id")["length"].sum().max() <= 1024


def test_run(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "personal_data", "best_fit_packing"]
    assert cp.run(spark, FOLDER).count() > 0
