"""Literal search against plain substring tests."""

from codelode.operators.related import holding


def test_literal_search_by_the_longest_word(spark):
    texts = ["in berlin", "begin berliner x", "in  berlin", "berlin", "", None, "a\tin berlin in", "inberlin", "x in", "in b"]
    terms = ["in berlin", "berlin", "in", " in", "in ", "n b", "berlin x", "er x", " ", None, "in berlin in", "in  berlin"]
    hay = spark.createDataFrame(list(enumerate(texts)), "k int, hay string")
    got = {(r.term, r.k) for r in holding(spark.createDataFrame([(t,) for t in terms], "term string"), hay, ["k"]).collect()}
    assert got == {(t, k) for t in terms if t and t.strip() for k, text in enumerate(texts) if text and t in text}
