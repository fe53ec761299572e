from luxflow.llm.common import texts_of


def test_tasks_get_small_batches(spark):
    """A worker and its JVM hold a batch of texts at a time, whatever its length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        docs = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text").coalesce(1)
        sizes = texts_of(docs).mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1).set_column(0, "n", [b.num_rows]) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) <= 500
    finally:
        spark.conf.set(key, before)
