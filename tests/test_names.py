"""Dictionary and mention queries: names of any frequency, sentences of any length, on small tables made here."""

import pytest

import __spark_entry__ as entry

LONG = "The beetle " + "and more words " * 50 + "met a weevil here."


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("names"))
    docs = [(1, LONG, "en", "a", len(LONG)), (2, "weevil " * 51 + "again.", "en", "a", 363), (3, "Beetle, weevil.", "en", "b", 15), (4, None, "en", "b", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    items = [(1, "beetle weevils weevil"), (2, "an ant"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows(spark, sf, name, *cols):
    return sorted(tuple(r) for r in entry.queries()[name](spark, sf).select(*cols).collect())


def test_a_sentence_above_600_characters_gives_mentions_and_pairs(spark, sf):
    assert len(LONG) > 700
    assert rows(spark, sf, "win_06_first_mentions", "doc_id", "name", "pos") == [(1, "beetle", 1), (1, "weevil", 154), (2, "weevil", 0), (3, "beetle", 0), (3, "weevil", 1)]
    # both names have an even number of letters, so both are hosts and make no pair
    assert rows(spark, sf, "join_15_typed_pairs", "doc_id") == []


def test_a_name_found_more_than_50_times_is_kept(spark, sf):
    assert rows(spark, sf, "agg_18_term_document_frequency", "token", "n_docs", "n_hits") == [("beetle", 2, 2), ("weevil", 3, 53)]
    hits = rows(spark, sf, "join_12_dictionary_hits", "doc_id", "start", "len", "gram")
    assert len([h for h in hits if h[0] == 2]) == 51


def test_two_word_names_need_no_support(spark, sf):
    hits = rows(spark, sf, "join_12_dictionary_hits", "doc_id", "start", "len", "gram")
    assert [h for h in hits if h[0] == 3] == [(3, 0, 1, "beetle"), (3, 1, 1, "weevil")]
    assert not [h for h in hits if h[3] == "ant"]  # below six letters


def test_pairs_of_the_other_type_in_order(spark, tmp_path):
    d = str(tmp_path)
    text = "Spiders met a beetle and another spiders."
    spark.createDataFrame([(1, text, "en", "a", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "beetle spiders")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert rows(spark, d, "join_15_typed_pairs", "doc_id", "first", "second") == [(1, "spiders", "beetle")]
