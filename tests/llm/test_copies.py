from __future__ import annotations

from collections import Counter

from fringeflow.llm import decontaminate

ITEM = "A train leaves for Berlin with 120 people at 3.5 km per hour. Then Anna counts 1,200 more; it's 7 o'clock in Paris and Rome."


def leaked(spark, make_docs, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(make_docs(docs), bench, copies=True).collect()
    return {(r.doc_id, r.item_id) for r in got if r.leaked}


def test_copies_in_any_layout(spark, make_docs, prose):
    bare = "".join(c for c in ITEM if c.isalnum() or c == " ")
    docs = [
        (1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.replace(" ", "\n")), (4, f"{prose(20)} {bare} {prose(9)}"),
        (5, ITEM.replace(" ", "  \t").title()), (6, prose(60)),
        (7, ITEM.replace("Berlin", "Madrid").replace("120 ", "98 ").replace(" ", "\n")),
    ]
    assert leaked(spark, make_docs, docs, [(1, ITEM)]) == {(i, 1) for i in (1, 2, 3, 4, 5, 7)}


def test_short_items_and_items_of_few_plain_words(spark, make_docs, prose):
    count, names = "1 2 3 4 5 6 7 8 9 10", "then Anna, Bert, Carl, Dora, Emil, Fritz, Gina, Hans, Ida"
    items = [(1, count), (2, names), (3, "What is 2 plus 3"), (4, "7 km"), (5, "")]
    docs = [
        (1, f"{prose(20)} {count} {prose(9)}"), (2, f"{prose(20)}. {names.lower()}"), (3, f"{prose(30)} what is 2 plus 3? {prose(8)}"),
        (4, "what is 5 plus 9"), (5, f"so: what is 5 plus 9 {prose(9)}"), (6, "it was 7 km away"), (7, "it was 8 km away"),
        (8, "1 2 3 4 5 6 7 8 9 11"), (9, "what is 2"), (10, ""), (11, None),
    ]
    assert leaked(spark, make_docs, docs, items) == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (6, 4)}


def test_rows_of_one_id_are_judged_by_their_own_text(spark, make_docs, prose):
    words = ITEM.split()
    docs = [(None, ITEM), (None, prose(50)), (None, None), (1, ITEM.lower()), (1, prose(40)), (1, prose(40)), (2, prose(30))]
    pieces = [(3, " ".join(words[:10]) + " " + prose(20)), (3, " ".join(words[:3]) + " x " + " ".join(words[4:14]))]
    clean = [r for r in docs if (r[1] or "").lower() != ITEM.lower()] + pieces
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate.drop_leaks(make_docs(docs + pieces), bench)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(clean)
    assert leaked(spark, make_docs, docs + pieces, [(1, ITEM)]) == {(None, 1), (1, 1)}
