import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from proofbox.llm import secret_scan
from proofbox.llm.common import stored
from test_near_dup import brute as near_brute
from test_decontaminate import brute as leak_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_keeps_the_columns(kept, spark):
    assert [n for n, _, _ in kept] == [n for n, _ in P.STAGES]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for _, _, after in kept[:-1])


def test_quality_stage_keeps_what_scores_well(kept, spark):
    _, before, after = kept[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(before)) - set(ids(after))
    assert gone and all(labels.get(i, 0) == 0 for i in gone)


def test_near_dup_stage_against_brute_force(kept):
    _, before, after = kept[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(g[0] for g in near_brute(rows))


def test_decontamination_stage_against_brute_force(kept, spark):
    _, before, after = kept[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = leak_brute([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(after) == sorted(k[0] for k in want if not k[5])


def test_secret_stage_redacts_and_keeps_every_document(kept):
    _, before, after = kept[3]
    assert ids(before) == ids(after)
    text = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        assert text[r.doc_id].text == secret_scan.redacted(r.text, "[SECRET]") and text[r.doc_id].n_chars == len(text[r.doc_id].text)
        assert not re.search("[0-9a-f]{16}|AKIA[A-Z0-9]{14}", text[r.doc_id].text)


def test_packing_stage_holds_every_document(kept):
    _, before, after = kept[4]
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(ids(before))
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_run_gives_the_same_pieces(kept, spark):
    assert P.run(spark, SF).count() == kept[-1][2].count()


def test_odd_documents_go_through_all_stages(spark, tmp_path):
    """Repeated and null ids, null and empty texts, extra columns: every stage keeps what it should; and an empty table."""
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(0, None), (0, ""), (None, "a text of a row without an id, long enough to be one"), (None, None), (1, "another text under an id that is taken, with words of its own")], "doc_id long, text string")
    for c in docs.columns:
        if c not in odd.columns:
            odd = odd.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    whole = some.unionByName(odd.select(docs.columns)).withColumn("label", F.lit("x")).withColumn("h", F.lit(3)).withColumn("score", F.lit(0.5))
    whole.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        after = stored(stage(spark, now, folder), f"odd-{name}")
        if name != "best_fit_packing":
            assert after.columns == now.columns and after.count() <= now.count(), name
        if name == "minhash_near_dedup":
            assert after.where("text is null or text = ''").count() == now.where("text is null or text = ''").count()
        now = after
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{folder}/e/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/e/{name}.parquet")
    assert P.run(spark, f"{folder}/e").count() == 0
