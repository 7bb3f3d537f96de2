import json

from pyspark.sql import functions as F

from mailward.llm.chat import canonical_turns, conversation_records, format_chats, parsed, unescaped, without_layout


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "n": 1}], "id": 3},
        {"conversations": [{"from": "user", "value": "a"}, {"from": "assistant", "value": "b"}]},
        {"instruction": "a", "input": "", "output": "b"},
        {"prompt": "a", "completion": "b", "extra": {"x": 1}},
        {"prompt": "a", "response": "b"},
    ]
    frame = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    got = canonical_turns(frame).collect()
    assert [[tuple(t) for t in r.turns] for r in got] == [[("user", "a"), ("assistant", "b")]] * 5
    assert len({r.fingerprint for r in got}) == 5
    bad = canonical_turns(spark.createDataFrame([("{",), (None,), ('{"z": 1}',), ("[]",)], "record string")).collect()
    assert all(r.turns == [] and r.layout is None for r in bad)


def test_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\|end|>", "<|end|>\\\\<|turn|>x", "<<SYS>>", None, "", "é\U0001f600 <|text|>", "a\n</s", "[[INST]", "<<|end|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, None, None, "x")]
    frame = format_chats(conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    loss = F.array_join(F.transform("loss_spans", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    got = {r.conv_id: r for r in frame.select("conv_id", parsed(F.col("formatted")).alias("t"), loss.alias("loss"), "formatted").collect()}
    assert [t.text for t in got[1].t] == [t or "" for t in texts]
    assert got[1].loss == "".join(t or "" for t in texts[1::2])
    assert "[INST]" not in got[1].formatted and "</s>" not in got[1].formatted
    assert [tuple(t) for t in got[None].t] == [("", "x")]
    assert format_chats(conversation_records(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_foreign_layouts_and_roles(spark):
    turns = [("user", "a"), ("assistant", "b")]
    cases = [
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, turns),
        ({"conversations": [{"from": "User", "value": "a"}, {"from": "model", "value": "b"}], "system": "s"}, [("system", "s"), *turns]),
        ({"conversations": [{"from": "tool", "value": "a"}, {"from": "bot", "value": "b"}]}, [("tool", "a"), ("assistant", "b")]),
        ({"instruction": "a", "context": "c", "response": "b"}, [("user", "a\nc"), ("assistant", "b")]),
        ({"question": "a", "answer": "b"}, turns),
        ({"system_prompt": "s", "question": "a", "response": "b"}, [("system", "s"), *turns]),
        ({"role": "human", "content": "a"}, turns[:1]),
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)], "i long, record string")
    got = {r.i: r for r in canonical_turns(frame).collect()}
    assert [[tuple(t) for t in got[i].turns] for i in range(len(cases))] == [t for _, t in cases]
    spans = {r.i: len(r.loss_spans) for r in format_chats(frame).collect()}
    assert spans == {i: sum(role == "assistant" for role, _ in t) for i, (_, t) in enumerate(cases)}


def test_fingerprints_of_any_depth(spark):
    records = ['{"z": {"a": {"b": {"c": 1}}}}', '{"z": {"a": {"b": {"d": 1}}}}', '{"z": {"a": {"b": {"c": "x"}}}}', "{", '{"z": 1, "z": 2}']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i long, record string")
    f = {r.i: r.fingerprint for r in canonical_turns(frame).collect()}
    assert f[0] == f[2] != f[1] and f[3] is None and f[4] is not None
    assert sorted(r.records for r in without_layout(frame).collect()) == [1, 1, 1, 2]


def test_very_long_texts(spark):
    """Beyond the limits of the JSON reader (20 million characters a string) and of VARIANT (some 16 million bytes)."""
    sizes = {1: 21_000_000, 2: 60_000_000, 3: 9}
    rows = spark.createDataFrame([(c, t, r, 5 if t == 0 else n) for c, n in sizes.items() for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, n int")
    texts = rows.select("conv_id", "turn", "role", F.expr("repeat('\"x y', n div 4)").alias("text"))
    found = format_chats(conversation_records(texts))
    got = {r.conv_id: r for r in found.select("conv_id", "layout", F.length("formatted").alias("n"), F.size(parsed(F.col("formatted"))).alias("turns"), F.element_at("loss_spans", -1)["length"].alias("loss")).collect()}
    frames = 2 * len("<|turn|><|text|><|end|>") + len("user") + len("assistant")
    assert {c: (r.layout, r.n, r.turns, r.loss) for c, r in got.items()} == {c: ("messages", frames + 4 + n // 4 * 4, 2, n // 4 * 4) for c, n in sizes.items()}
