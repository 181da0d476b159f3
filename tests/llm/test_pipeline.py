import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline
from colligate.llm.shared import written
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide_as_brute_force_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    extra = spark.createDataFrame([(900, None, "en", "s", 0), (901, "12 34 !!", "en", "s", 8), (902, docs.first().text, "en", "s", 1)], docs.schema)
    docs = written(docs.union(extra), spark)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    one = written(stages["language_id"](spark, docs, SF), spark)
    assert one.columns == columns and docs.count() - one.count() == 2
    two = written(stages["line_dedup"](spark, one, SF), spark)
    gone = brute.lines([(r.doc_id, r.text) for r in one.collect()])
    wanted = {}
    for r in one.collect():
        kept = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id])
        if not gone[r.doc_id] or kept.strip():
            wanted[r.doc_id] = kept
    assert {r.doc_id: r.text for r in two.collect()} == wanted and two.columns == columns
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = written(stages["near_dedup"](spark, two, SF), spark)
    assert {r.doc_id for r in three.collect()} == {d for d, _, _, kept in brute.near([(r.doc_id, r.text) for r in two.collect()]) if kept}
    four = written(stages["decontamination"](spark, three, SF), spark)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in four.collect()} == {x[0] for x in brute.contamination([(r.doc_id, r.text) for r in three.collect()], items) if not x[5]}
    five = stages["bpe"](spark, four, SF)
    assert five.count() == four.count() and five.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_stages_take_any_table(spark):
    """Nulls in every column, repeated rows, ties, empty texts, columns whose names clash, no rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    first = docs.first()
    extra = [(None, None, None, None, None), (None, first.text, "en", None, 1), (900, "", None, "s", 0), (901, first.text, None, None, None), (901, first.text, None, None, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    docs = docs.withColumn("cg_lang", F.lit(1)).withColumn("CG_REMOVED", F.lit("x")).withColumn("hits", F.array(F.lit(1)))
    for held in (docs, docs.where("false")):
        held = written(held, spark)
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, held, SF), spark)
            assert name == "bpe" or after.columns == docs.columns
            held = after if name != "bpe" else held
    assert docs.where("doc_id = 901").count() == 2


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("n_tokens > 0").count() > 100
