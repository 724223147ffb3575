from pyspark.sql import functions as F

import corpus_pipeline
from countloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "packing"]
    kept, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns and kept.count() <= before
        before = kept.count()
    assert before > 0.6 * docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_hard_documents(spark, docs, texts):
    """Null, empty and very long texts, copies, near copies, shared passages, null and repeated ids, clashing columns."""
    own = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    kept, tables = own, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), name)
        assert kept.columns == own.columns
        tables.append(kept)
    clean, single, cut = (t.select("doc_id", "text", "n_chars").collect() for t in tables)
    assert {r.doc_id for r in clean} >= {400, 401, 402, 403, 404, 407, None} and {r.doc_id for r in single} <= {r.doc_id for r in clean}
    groups = [set(range(200, 240)) | set(range(300, 310)), {400, 401, 402}]  # one of each stays; of the second the one without text
    for group in groups:
        assert len(group & {r.doc_id for r in clean}) and len([r for r in single if r.doc_id in group]) == 1
    assert {r.doc_id for r in single} >= set(range(100, 106)) & {r.doc_id for r in clean} and [r.doc_id for r in single].count(None) == [r.doc_id for r in clean].count(None)
    before = {r.doc_id: r.text for r in single if r.doc_id is not None}
    shorter = [r.doc_id for r in cut if r.doc_id is not None and r.doc_id not in (5, 6) and r.text != before[r.doc_id]]
    assert set(shorter) <= set(range(100, 106)) and len(shorter) == len(set(range(100, 106)) & set(before)) - 1  # the first keeps the passage
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).select("doc_id").distinct().count() == len({r.doc_id for r in cut})


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
