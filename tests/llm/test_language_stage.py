"""The language stage where nothing is labelled, and on documents known to be clean."""

from onsetlens.llm.language_id import with_known_language


def test_without_labels_all_texts_with_a_letter_stay(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "", None), (5, "слово 日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in with_known_language(docs).collect()) == [1, 5]


def test_clean_labelled_documents_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang IS NOT NULL AND text RLIKE '[a-z]'")
    assert docs.count() and with_known_language(docs).count() == docs.count()
