"""Documents without an id, and with one that others have, too."""

from netlytics.llm import decontamination, jaccard_join

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_near_copies_of_rows_without_own_ids(spark):
    other = "a text that no other document of this table looks like at all"
    rows = [(1, WORDS), (1, WORDS), (None, WORDS), (None, other), (None, other), (2, "something else again that stands alone here"), (2, "and one more that has its id but no word of it"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = jaccard_join.keep_one_of_each(df, k=4, num=85)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([(1, WORDS), (None, other), rows[5], rows[6], (3, None)], key=str)


def test_decontamination_judges_each_row(spark):
    benchmark = spark.createDataFrame([(1, WORDS)], "item_id long, text string")
    rows = [(1, WORDS), (1, "clean"), (None, WORDS + " and so on"), (None, "clean too"), (2, "clean as well"), (2, "clean as well")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert sorted(kept.collect(), key=str) == sorted([rows[1], *rows[3:]], key=str)
