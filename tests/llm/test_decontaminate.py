from __future__ import annotations

from collections import Counter

import regex

from fringeflow.llm import decontaminate

UNITS = "|".join(decontaminate.UNITS)


def marked(text):
    text = regex.sub("[\x01-\x04]", " ", text or "")
    text = regex.sub(r"(?<=\d)[.,](?=\d)", "\x04", text)
    text = regex.sub(r"(?<=[\p{L}\d,;] )(?=\p{Lu}\p{Ll})", "\x01", text)
    text = regex.sub("(?<![\\p{L}\\d\x04])[0-9][0-9\x04]*", lambda m: f" \x02{m[0]} ", text)
    text = regex.sub(rf"(?<=\d )\s*(?=(?:{UNITS})(?![\p{{L}}\d]))", " \x03", text)
    return regex.findall("[\\p{L}\\p{N}\x01-\x04]+", text.lower())


def windows(words):
    """Place and words of each window of 8, or of all words together."""
    if not words:
        return []
    return [(i, tuple(words[i : i + 8])) for i in range(max(1, len(words) - 7))]


def template(window):
    return tuple(w[0] if w < "\x05" else w for w in window)


def leaked_pairs(docs, items):
    found, marks = set(), {item: marked(item) for _, item in items}
    for doc_id, text in docs:
        theirs = {}
        for q, v in windows(marked(text)):
            theirs.setdefault(template(v), []).append((q, v))
        for item_id, item in items:
            words = marks[item]
            ours = [(p, w) for p, w in windows(words) if 2 * sum(x >= "\x05" for x in w) >= len(w)]
            meetings = {}
            for p, w in ours:
                for q, v in theirs.get(template(w), ()):
                    meetings.setdefault(q - p, []).append((w, v))
            for pairs in meetings.values():
                slots = {(a, b) for w, v in pairs for a, b in zip(w, v) if a < "\x05"}
                steady = len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots})
                if steady and len(pairs) >= min(5, len(ours)):
                    found.add((doc_id, item_id))
    return found


ITEM = "A train leaves for Berlin with 120 people at 3.5 km per hour and then Anna counts 120 more people in Berlin while 7 wait outside"


def test_marks():
    assert marked("Meet Anna, 1,200 km or 5kg.") == ["meet", "\x01anna", "\x021\x04200", "\x03km", "or", "\x025", "\x03kg"]


def test_same_other_and_inconsistent_slots(spark, make_docs, prose, awkward):
    swapped = ITEM.replace("Berlin", "Paris").replace("120", "98").replace("3.5 km", "12 miles")
    uneven = ITEM.replace("120 more", "121 more")
    docs = [
        (900, f"{prose(30)}. {ITEM}. {prose(10)}"), (901, f"{prose(3)} {swapped}"), (902, uneven), (903, ITEM.upper()),
        (904, prose(200)), (905, ITEM[:70]), (906, "what is 5 plus 9"), (907, "what is 5 plus 9 now"), (908, ITEM), (908, ITEM),
        (909, prose(500) + " " + ITEM), (None, ITEM),
    ]
    docs += [r for r in awkward if len(r[1] or "") < 10_000]
    items = [(1, ITEM), (2, "What is 2 plus 3"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10"), (1, ITEM), (None, prose(20))]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hash string")
    frame = make_docs(docs)
    got = decontaminate.find_leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.leaked} == leaked_pairs(docs, items)
    rows = {(r.doc_id, r.item_id): r for r in got}
    assert rows[901, 1].n_changed == 4 and rows[901, 1].leaked
    assert not rows[902, 1].consistent and not rows[902, 1].leaked
    assert rows[906, 2].leaked and (907, 2) not in rows and (904, 1) not in rows
    kept = decontaminate.drop_leaks(frame, bench)
    # Rows go by id and text; with copies, so do the one in capitals, that with one other number, and that with a short item inside.
    gone = {row for row in docs if row[0] in (902, 903, 907) or leaked_pairs([row], items)}
    assert kept.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d for d in docs if d not in gone)


def test_empty_tables(spark, make_docs, prose):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.find_leaks(make_docs([]), bench).collect() == []
    assert decontaminate.find_leaks(make_docs([(1, ITEM)]), bench.limit(0)).collect() == []


def test_leaks_match_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    bench = spark.read.parquet(f"{data_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).where("leaked").collect()}
    some = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    verbatim = {(d, i) for d, text in some for i, item in items if item in text}
    assert verbatim <= got
    assert {d for d, _ in got} == {d for d, _ in leaked_pairs(some, items)}
