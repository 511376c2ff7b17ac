from docmill.llm import registry as R


def test_texts_of_pages_come_in_one_form(spark, tmp_path):
    spark.createDataFrame([("a", "Главный бухгaлтер"), ("b", "Bank слово"), ("c", None)], "page_hash string, text string").write.parquet(f"{tmp_path}/ocr_cache.parquet")
    got = {r.page_hash: r.text for r in R.QUERIES["p4_normalized_texts"](spark, str(tmp_path)).collect()}
    assert got == {"a": "Главный бухгалтер", "b": "Bank слово", "c": None}
