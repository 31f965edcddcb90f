import random

from chromloom.llm import quotes


def quote(text, marks=">"):
    return "\n".join(f"{marks} {line}" for line in text.split("\n"))


def test_nested_levels():
    own, units = quotes.parse_message("Yes.\n> I think so\n>> is it?\n> > is it,\n> > really\nbye\n>third")
    assert own == "Yes.\nbye"
    assert {(p, level) for p, level, _, _ in units} == {(0, 0), (1, 1), (2, 2), (3, 1)}
    assert quotes.unit_hash("Is IT\n really") == quotes.unit_hash("is it really")
    assert quotes.parse_message("a > b\n\n\n\nc")[0] == "a > b\n\n\n\nc" and quotes.parse_message(None) == ("", [])


def build(seed=1):
    r = random.Random(seed)
    rows, want = [], {}
    for conv in range(12):
        own = {}
        for turn in range(0, r.randrange(1, 40)):
            text = "\n".join(f"c{conv} t{turn} l{k} " + " ".join(r.choices("abcdefgh", k=5)) for k in range(r.randrange(1, 4)))
            if turn and r.random() < 0.1:
                text = own[r.randrange(turn)]  # the same text again: the latest counts
            body, parent, linked, n = text, turn - 1 if turn else None, 0, 0
            if turn and r.random() < 0.6:
                old = r.randrange(turn)
                passage = own[old] if r.random() < 0.5 else own[old].split("\n")[0]
                latest = max(t for t, x in own.items() if passage == x or passage in x.split("\n"))
                body, parent, linked, n = f"{quote(passage.upper())}\n{text}\n{quote('nobody said this', '>>>')}", latest, 1, 2
            own[turn] = text
            rows.append((conv, turn, "user", body))
            want[conv, turn] = (text, parent, n, linked)
    return rows, want


def test_replies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK", 5)
    rows, want = build()
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got.keys() == want.keys()
    for key, (text, parent, n, linked) in want.items():
        r = got[key]
        assert (r["content"], r["reply_to"], r["n_quotes"], r["n_linked"], r["by_quote"]) == (text, parent, n, linked, linked > 0)
        depth, turn = 0, key[1]
        while want[key[0], turn][1] is not None:
            depth, turn = depth + 1, want[key[0], turn][1]
        assert (r["root_turn"], r["depth"]) == (turn, depth)
        assert r["chat"] == f"<|user|>\n{text}\n<|end|>\n"


def test_odd_rows(spark):
    rows = [(None, 1, "user", "> x", 1), (1, None, None, None, 2), (2, 0, "user", "", 3), (2, 7, "user", "> hello\nyes", 4), (2, 7, "user", "> hello\nyes", 4), (2, 3, "user", "hello", 5)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = quotes.link_conversations(messages)
    assert got.columns[:5] == ["conv_id", "turn", "role", "text", "content"]
    found = sorted(((r["conv_id"] or -1, r["turn"] or -1, r["content"], r["reply_to"], r["depth"], r["n_linked"]) for r in got.collect()), key=str)
    assert found == sorted([(-1, 1, "", None, 0, 0), (1, -1, "", None, 0, 0), (2, -1, "", None, 0, 0), (2, 3, "hello", 0, 1, 0), (2, 7, "yes", 3, 2, 1), (2, 7, "yes", 3, 2, 1)], key=str)
    assert quotes.link_conversations(messages.limit(0)).count() == 0


def test_conversations_hold_all_messages_in_the_order_of_replies(spark):
    rows, want = build(3)
    rows += [(None, 1, "user", "alone"), (None, 1, "user", "alone"), (4, None, "user", "no turn")]
    linked = quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole, few = (quotes.build_conversations(linked, max_messages=k, max_chars=c).collect() for k, c in ((10_000, 10**9), (3, 60)))
    assert all(r["n_messages"] == len(r["messages"]) for r in whole) and all(r["n_messages"] <= 3 for r in few) and len(few) > len(whole)
    for got in (whole, few):
        by_root = {}
        for r in sorted(got, key=lambda r: (r["first_depth"], r["first_turn"] or 0)):
            by_root.setdefault((r["conv_id"], r["root_turn"]), []).append(r)
        found = {(c, m["turn"]): (c, root, m["depth"], m["reply_to"]) for (c, root), rs in by_root.items() for r in rs for m in r["messages"] if c is not None and m["turn"] is not None}
        assert found.keys() == want.keys() and sum(r["n_messages"] for r in got) == len(rows)
        for (c, _), rs in by_root.items():
            messages = [m for r in rs for m in r["messages"]]
            if c is not None and messages[0]["turn"] is not None:
                seen = set()
                for m in messages:
                    assert m["content"] == want[c, m["turn"]][0] and (m["reply_to"] is None or m["reply_to"] in seen)
                    seen.add(m["turn"])
                assert "".join(r["chat"] for r in rs) == "".join(f"<|user|>\n{m['content']}\n<|end|>\n" for m in messages)
    assert [r["n_messages"] for r in whole if r["conv_id"] is None] == [1, 1]
    assert quotes.build_conversations(linked.limit(0)).count() == 0


def test_rows_do_not_depend_on_partitions(spark):
    rows, _ = build(3)
    linked = quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).persist()
    found = []
    for n, adaptive in ((3, "true"), (29, "false"), (8, "false")):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            found.append(sorted(map(str, quotes.build_conversations(linked, max_messages=3, max_chars=100).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] == found[1] == found[2] and len(found[0]) > 3
    linked.unpersist()
