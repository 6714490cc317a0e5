"""Tool calls: links, order, validation, canonical JSON."""

import json

from pairloom.llm import chat

SCHEMAS = {
    "find": {"q": ("string", True), "n": ("integer", False), "from": ("reference", False), "other": ("reference", False)},
    "sum": {"x": ("number", True), "tags": ("array", False), "opt": ("object", False), "on": ("boolean", False)},
}

CALLS = [
    (1, 1, "a", "find", '{"q": "é\\n", "n": 3}'),
    (1, 3, "b", "find", '{"n": 1, "from": "a", "q": "x"}'),
    (1, 5, "c", "find", '{"q": "x", "from": "a", "other": "b"}'),
    (1, 6, "c", "find", '{"q": "later copy"}'),
    (1, 7, "d", "sum", '{"x": 1.5, "tags": [1], "opt": {"z": 1, "a": 2}, "on": true}'),
    (1, 9, "e", "sum", '{"x": "no", "tags": {}, "more": 1}'),
    (1, 11, "f", "find", "not json"),
    (1, 13, "g", "fly", "{}"),
    (2, 1, "a", "find", '{"q": "x", "from": "b"}'),
    (2, 2, "b", "find", '{"q": "x", "from": "a"}'),
    (2, 3, "h", "find", '{"q": "x", "from": "gone"}'),
    (2, 4, "i", "find", None),
    (None, 1, "a", "sum", '{"x": 7}'),
    (3, 1, None, "sum", '{"x": 7}'),
    (3, 2, "s", "sum", "[1]"),
]
RESULTS = [(1, 2, "a", "fine"), (1, 1, "b", "too soon"), (1, 9, "d", "one"), (1, 8, "d", "two"), (1, 20, "zz", "lost"), (None, 2, "a", "n"), (3, 3, None, "m")]


def linked(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string").repartition(3)
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    rows = chat.link(c, r, SCHEMAS).collect()
    named = {(x.conv_id, x.call_id): x for x in rows if x.status != "repeated"}
    assert len(named) == sum(x.status != "repeated" for x in rows)
    # Every call and every result is in exactly one row.
    again = [x for x in rows if x.status == "repeated"]
    assert sum(x.name is not None for x in named.values()) + sum(x.copies for x in again) == len(calls)
    assert sum(x.answers > 0 for x in named.values()) + sum(x.answers for x in again) == len(results)
    linked.again = sorted((x.conv_id, x.call_id, x.turn, x.result_turn, x.copies, x.answers, x.record) for x in again)
    return named


def test_links_order_and_errors(spark):
    got = linked(spark, CALLS, RESULTS)
    assert len(got) == len({(c[0], c[2] or "") for c in CALLS}) + 1
    level = {k: v.level for k, v in got.items()}
    assert [level[1, c] for c in "abcdefg"] == [0, 1, 2, 0, 0, 0, 0]
    assert level[2, "a"] is None and level[2, "b"] is None and level[2, "h"] == 0
    errors = {k: v.errors for k, v in got.items()}
    assert errors[1, "a"] == [] and errors[1, "d"] == [] and got[1, "c"].copies == 2
    assert errors[1, "e"] == ["tags is not array", "unknown more", "x is not number"]
    assert errors[1, "f"] == ["not JSON"] and errors[1, "g"] == ["unknown tool"] and errors[2, "i"] == ["not JSON"]
    assert errors[2, "h"] == ["no call gone"] and errors[3, "s"] == ["not an object"]
    status = {k: v.status for k, v in got.items()}
    assert status[1, "a"] == "linked" and status[1, "b"] == "early" and status[1, "c"] == "pending" and status[1, "zz"] == "orphan"
    assert got[1, "d"].answers == 2 and got[1, "d"].result_turn == 8
    assert [(*x[:4], *x[4:6], json.loads(x[6])) for x in linked.again] == [
        (1, "c", 6, None, 1, 0, {"arguments": {"q": "later copy"}, "call_id": "c", "name": "find"}),
        (1, "d", None, 9, 0, 1, {"call_id": "d", "content": "one"}),
    ]
    assert status[None, "a"] == "linked" and status[3, ""] == "linked"
    assert got[1, "a"].valid and not got[2, "a"].valid and not got[1, "zz"].valid


def test_records_are_canonical(spark):
    got = linked(spark, CALLS, RESULTS)
    record = got[1, "d"].record
    assert json.loads(record)["arguments"]["opt"] == {"a": 2, "z": 1}
    assert record == json.dumps(json.loads(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    other = [(1, 1, "a", "find", '{ "n":3,   "q":"\\u00e9\\u000a"}')]
    assert linked(spark, other, [(1, 2, "a", "fine")])[1, "a"].record == got[1, "a"].record


def test_empty_and_plain_turns(spark):
    c = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string")
    r = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    assert chat.link(c, r, SCHEMAS).count() == 0
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}" if t % 4 else None) for t in range(12)] + [(None, None, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results, others = chat.as_tool_calls(turns)
    got = chat.link(calls, results, chat.SCHEMAS, others).collect()
    assert sorted((x.turn, x.level) for x in got if x.conv_id == 1 and x.turn) == [(1, 0), (3, 1), (5, 1), (7, 2), (9, 2), (11, 2)]


def turns_of(rows):
    """What ``as_tool_calls`` and ``link`` must give for plain turns, by loops."""
    calls, results, out = {}, {}, []
    for conv, turn, role, text in rows:
        if role == "assistant" and turn is not None:
            calls.setdefault((conv, f"call-{turn}"), []).append((turn, text))
        elif role == "user" and turn is not None and turn > 0:
            results.setdefault((conv, f"call-{turn - 1}"), []).append((turn, text))
        else:
            out.append((conv, None, turn, None, "context", None, json.dumps({k: v for k, v in (("name", role), ("content", text)) if v is not None})))
    first = lambda rows: min(rows, key=lambda r: (r[1] is not None, r[1] or ""))  # noqa: E731  (one turn per identifier here)

    def level(conv, turn):
        up = 2 * ((turn + 1) // 4) - 1 + (turn + 1) % 2
        return 0 if up < 1 or (conv, f"call-{up}") not in calls else level(conv, up) + 1

    for key in {*calls, *results}:
        mine, answers = calls.get(key, []), results.get(key, [])
        errors, record, lev = [], {"call_id": key[1]}, None
        if mine:
            turn, text = first(mine) if len({t for _, t in mine}) > 1 else mine[0]
            size, tool = len(text or ""), ("search", "lookup", "write")[turn % 3]
            up = 2 * ((turn + 1) // 4) - 1 + (turn + 1) % 2
            args = {"query": text, "after": f"call-{up}" if up >= 1 else None}
            if tool == "search":
                args["limit"] = str(size) if size % 5 == 0 else size
                errors += ["limit is not integer"] * (size % 5 == 0)
            args |= {"exact": size % 2 == 0} if tool == "lookup" else {"score": size / 2} if tool == "write" else {}
            errors += ["missing query"] * (text is None)
            errors.sort()
            errors += [f"no call call-{up}"] * (up >= 1 and (key[0], f"call-{up}") not in calls)
            lev = level(key[0], turn)
            record |= {"name": tool, "level": lev, "arguments": {k: v for k, v in args.items() if v is not None}}
        else:
            record["arguments"] = None
        if answers and (content := first(answers)[1]) is not None:
            record["content"] = content
        status = "orphan" if not mine else "linked" if answers else "pending"
        out.append((*key, mine[0][0] if mine else None, answers[0][0] if answers else None, status, lev, json.dumps(record)))
    loads = lambda r: (*r[:6], json.loads(r[6]))
    return sorted(map(loads, out), key=repr), {k: len(v) for k, v in calls.items()}, {k: len(v) for k, v in results.items()}


def plain(rows):
    return sorted(((x.conv_id, x.call_id, x.turn, x.result_turn, x.status, x.level, json.loads(x.record)) for x in rows), key=str)


def test_every_turn_is_in_one_row(spark):
    import random

    rng = random.Random(3)
    rows = [
        (rng.choice([1, 2, 3, None]), turn, rng.choice(["assistant", "assistant", "user", "system", None]), rng.choice(["a", "bb cc", "ddddd", None, '"q"']))
        for turn in [*range(-1, 30), *range(0, 30), None, None, None]
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    calls, results, others = chat.as_tool_calls(turns)
    got = chat.link(calls, results, chat.SCHEMAS, others).collect()
    want, called, answered = turns_of(rows)
    whole = [x for x in got if x.status != "repeated"]
    assert [r[:6] for r in plain(whole)] == [r[:6] for r in sorted(want, key=str)]
    # Which of several rows of one identifier comes first is the engine's order of arguments; the others are compared whole.
    alone = lambda r: called.get(r[:2], 1) == answered.get(r[:2], 1) == 1
    assert [r for r in plain(whole) if alone(r)] == [r for r in sorted(want, key=str) if alone(r)]
    again = [x for x in got if x.status == "repeated"]
    used = sum(x.status == "context" for x in whole) + sum(x.name is not None and x.status != "context" for x in whole)
    used += sum(x.answers > 0 for x in whole) + sum(x.copies + x.answers for x in again)
    assert used == len(rows)
