from tidemark.llm.leaks import leaks


def test_short_passages_kept_in_short_stretches_are_found(spark):
    han = [chr(0x4E00 + 3 * k) for k in range(15)]
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "".join(han))], "item_id bigint, passage string")
    # a word in the middle leaves 2 of 4 runs; two characters put in leave 6 of 12, two by two
    docs = spark.createDataFrame([(1, "one two three more four five six"), (2, "".join(han[:5] + ["山"] + han[5:10] + ["水"] + han[10:]))], "doc_id bigint, text string")
    assert sorted((r.item_id, r.doc_id) for r in leaks(docs, items).collect()) == [(1, 1), (2, 2)]
