from __future__ import annotations

import json
import random

from fringeflow.llm.queries import QUERIES
from fringeflow.llm.tool_calls import EXCHANGE_SCHEMAS, exchange_events, link_calls
from fringeflow.sources.stage_store import SETTLED

SCHEMAS = {"add": {"a": ("integer", True), "b": ("integer", False)}, "say": {"text": ("string", True), "after": ("reference", False)}}
CALL = "conv_id long, turn long, call_id string, name string, arguments map<string,string>, status string"
RESULT = "conv_id long, turn long, call_id string, content string, wave int"


def linked(spark, calls, results, schemas=SCHEMAS):
    calls = spark.createDataFrame([(*c, "x") for c in calls], CALL)
    results = spark.createDataFrame([(*r, 9) for r in results], RESULT)
    return link_calls(calls, results, schemas).collect()


def test_links_problems_and_json(spark):
    calls = [
        (1, 0, "c1", "add", {"b": "2", "a": "-1"}),
        (1, 1, "c2", "add", {"a": "x", "z": "1"}),
        (1, 2, "c3", "say", {"text": 'q"\n é', "after": "ref:c1"}),
        (1, 3, "c4", "fly", {}),
        (1, 4, None, "say", None),
        (1, 5, "c5", "say", {"text": "  "}),
        (1, 5, "c5", "say", {"text": "  "}),
    ]
    results = [(1, 9, "c1", "late"), (1, 1, "c1", "3"), (1, 1, "c9", "lost"), (1, 1, None, "none"), (1, 6, "c5", None)]
    got = linked(spark, calls, results)
    rows = {(r.call_id, r.status): r for r in got}
    assert len(got) == 9
    first = rows["c1", "linked"]
    assert first.json == '{"arguments":{"a":-1,"b":2},"id":"c1","name":"add","result":"3"}'
    assert first.n_results == 2 and first.problems == "" and first.wave == 0
    assert rows["c2", "unanswered"].problems == "no integer a,unknown z"
    assert json.loads(rows["c3", "unanswered"].json)["arguments"] == {"text": 'q"\n é', "after": "ref:c1"}
    assert rows["c4", "unanswered"].problems == "unknown tool"
    assert rows[None, "unanswered"].problems == "missing text"
    assert [r.problems for r in got if r.call_id == "c5"] == ["no string text"] * 2
    assert rows["c9", "orphan"].json == '{"id":"c9","result":"lost"}' and rows[None, "orphan"].n_results == 1


def test_waves_order_references_and_find_cycles(spark):
    say = lambda after: {"text": "t", "after": f"ref:{after}"} if after else {"text": "t"}
    # Conversation 1 refers forward, 2 backward only, 3 in a circle with a call behind it.
    spec = {1: {"a": "b", "b": "c", "c": None}, 2: {"p": None, "q": "p"}, 3: {"x": "y", "y": "x", "z": "x", "w": "missing"}}
    calls = [(conv, t, name, "say", say(to)) for conv, part in spec.items() for t, (name, to) in enumerate(part.items())]
    got = {r.call_id: (r.wave, r.status) for r in linked(spark, calls, [])}
    assert [got[x][0] for x in "abc"] == [2, 1, 0]
    assert [got[x] for x in "pq"] == [(0, "unanswered")] * 2
    assert [got[x] for x in "xyz"] == [(None, "cycle")] * 3
    assert got["w"] == (0, "unanswered")


def test_explicit_and_plain_messages(spark):
    explicit = {"tool_calls": [{"id": "k", "name": "reply", "arguments": {"prompt": "p", "turn": 3}}]}
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None),
        (2, 0, "assistant", json.dumps(explicit)), (2, 1, "tool", json.dumps({"tool_call_id": "k", "content": "done"})),
        (3, 5, "assistant", "{broken"), (None, None, None, None), (4, 0, "user", ""), (4, 0, "user", ""),
    ]
    messages = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, m int")
    calls, results = exchange_events(messages)
    got = {r.call_id: r for r in link_calls(calls, results, EXCHANGE_SCHEMAS).collect()}
    assert got["k"].json == '{"arguments":{"prompt":"p","turn":3},"id":"k","name":"reply","result":"done"}'
    assert got["turn-1-1"].status == "linked" and got["turn-1-1"].problems == ""
    assert json.loads(got["turn-1-3"].json)["arguments"] == {"context": "ref:turn-1-1", "turn": 3}
    assert got["turn-1-3"].problems == "missing prompt"
    assert got["turn-3-4"].status == "orphan"
    assert got["turn-4-0"].problems == "no string prompt"
    empty = exchange_events(messages.limit(0))
    assert link_calls(*empty, EXCHANGE_SCHEMAS).collect() == []


def test_waves_follow_references_across_conversations_and_from_unnamed_calls(spark):
    say = lambda *after: {"text": "t", **{f"after{i}": f"ref:{a}" for i, a in enumerate(after)}}
    calls = [
        (1, 0, "a", "say", say("b")), (1, 1, "b", "say", say()), (1, 2, "c", "say", say("a")),
        (2, 9, "x", "say", say("a")),  # an earlier turn, but in a later wave
        (3, 0, "d", "say", say("e")), (3, 1, "e", "say", say("d")),
        (4, 5, "y", "say", say("d")),  # behind another conversation's cycle
        (5, 0, None, "say", say("f", "a")), (5, 0, None, "say", say("f")), (5, 0, None, "say", say()), (5, 0, None, "say", say("e")),
        (5, 1, "f", "say", say("y0")), (6, 0, "y0", "say", say("z")), (6, None, "z", "say", say()),
    ]
    got = linked(spark, calls, [(2, 10, "x", "r")])
    named = {r.call_id: (r.wave, r.status) for r in got if r.call_id}
    assert named["x"] == (1, "linked")
    assert [named[x] for x in "dey"] == [(None, "cycle")] * 3
    assert [named[x][0] for x in ("a", "b", "c", "f", "y0", "z")] == [1, 0, 1, 1, 1, 0]
    unnamed = sorted((r.wave is None, r.wave, r.status) for r in got if not r.call_id)
    assert unnamed == [(False, 0, "unanswered"), (False, 2, "unanswered"), (False, 2, "unanswered"), (True, None, "cycle")]


def test_waves_match_a_walk_over_all_references(spark):
    rnd = random.Random(11)
    n = 300
    turn = {i: rnd.randrange(40) for i in range(n)}
    order = rnd.sample(range(n), n)
    refs = {u: [order[rnd.randrange(k)] for _ in range(rnd.choice([0, 1, 1, 1, 2, 3])) if k] for k, u in enumerate(order)}
    # Circles of three and of five calls, and calls behind them.
    for first, size in ((n, 3), (n + 10, 5)):
        ring = range(first, first + size)
        turn |= {u: u % 7 for u in range(first, first + size + 2)}
        refs |= {u: [first + (u - first + 1) % size, rnd.randrange(n)] for u in ring}
        refs |= {first + size: [first], first + size + 1: [first + size, 0]}

    waves, open_now = {}, set()

    def walk(u):
        if u in open_now:
            return None
        if u not in waves:
            open_now.add(u)
            found = [(walk(v), 0 if turn[v] < turn[u] else 1) for v in refs[u]]
            open_now.discard(u)
            waves[u] = None if any(w is None for w, _ in found) else max((w + s for w, s in found), default=0)
        return waves[u]

    cyclic = [u for u in refs if u >= n]
    for u in range(n):
        walk(u)
    waves |= dict.fromkeys(cyclic)
    calls = [(u % 9, turn[u], f"c{u}", "say", {str(i): f"ref:c{v}" for i, v in enumerate(to)}) for u, to in refs.items()]
    got = {int(r.call_id[1:]): r for r in linked(spark, calls, [])}
    assert {u: r.wave for u, r in got.items()} == waves
    assert {u for u, r in got.items() if r.status == "cycle"} == set(cyclic)
    place = {u: (r.wave, r.turn, r.call_id) for u, r in got.items() if r.wave is not None}
    assert all(place[v] < place[u] for u in place for v in refs[u])
    assert max(w for w in waves.values() if w is not None) > 2


def test_chains_take_few_rounds(spark):
    n = 150
    calls = [(1, u, f"c{u}", "say", {"text": "t", "after": f"ref:c{u + 1}"}) for u in range(n)]
    calls += [(2, u, f"d{u}", "say", {"text": "t", "after": f"ref:d{u - 1}"}) for u in range(n)]
    since = len(SETTLED)
    got = {r.call_id: r.wave for r in linked(spark, calls, [])}
    assert len(SETTLED) - since <= 12
    assert [got[f"c{u}"] for u in range(n)] == [n - 1 - u for u in range(n)]
    assert {got[f"d{u}"] for u in range(n)} == {0}


def test_registered_query_orders_explicit_calls(spark, tmp_path):
    def said(conv, turn, *calls):
        calls = [{"id": i, "name": "reply", "arguments": {"prompt": "p", "turn": turn, **more}} for i, more in calls]
        return (conv, turn, "assistant", json.dumps({"tool_calls": calls}))

    rows = [
        said(1, 0, ("a", {"context": "ref:b"}), ("b", {})), said(2, 5, ("c", {"context": "ref:a"}), ("d", {"context": "ref:d"})),
        said(3, 7, ("e", {"context": "ref:d"}), (None, {"context": "ref:b2"})), said(3, 8, ("b2", {"context": "c"})),
        (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 2, "user", "on"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.call_id: (r.wave, r.status, r.problems) for r in QUERIES["op6_tool_calls"](spark, str(tmp_path)).collect()}
    assert got == {
        "a": (1, "unanswered", ""), "b": (0, "unanswered", ""), "c": (1, "unanswered", ""), "d": (None, "cycle", ""),
        "e": (None, "cycle", ""), None: (1, "unanswered", ""), "b2": (0, "unanswered", "no reference context"),
        "turn-4-0": (0, "linked", ""), "turn-4-2": (0, "unanswered", ""),
    }
