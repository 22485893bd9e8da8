"""Pipeline stages on ids that are null or not unique."""

from plotlens.llm import language_id, simhash_dedup


def test_near_copies_of_an_id_with_two_texts(spark):
    a = " ".join(f"alpha{i}" for i in range(40))
    b = " ".join(f"beta{i}" for i in range(40))
    c = " ".join(f"gamma{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, b), (None, c), (None, c), (None, b), (7, "x y z"), (7, "x y z")]
    kept = simhash_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == sorted([("5", a), ("3", b), ("None", c), ("7", "x y z")])


def test_language_of_each_row_of_an_id(spark):
    text = "the quick brown fox jumps over the lazy dog and runs through the forest"
    rows = [(i, text, "en") for i in range(30)] + [(1, "123 456", "en"), (None, text, "en"), (None, "789", "en"), (None, None, "en")]
    kept = language_id.keep_known(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len(kept) == 31 and {r.text for r in kept} == {text}
