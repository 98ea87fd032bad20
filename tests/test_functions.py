import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlake.functions import json_values as J
from sessionlake.functions import scalars as S
from sessionlake.sinks.yaml_text import dump

values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab\n/~ é", max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("ab/~", max_size=2), x, max_size=3), max_leaves=12)


def one(spark, column, *args):
    return spark.range(1).select(column(*[F.lit(a) for a in args])).first()[0]


@pytest.mark.parametrize(
    "function,args,expected",
    [
        (S.model_key, (" anthropic/claude_3.5 ",), "claude-3-5"),
        (S.model_key, ("  ",), None),
        (S.model_key, ("a/b/",), None),
        (S.project_key, ("claude:My_App.v2",), "my-app-v2"),
        (S.project_key, ("a:b:c",), "b:c"),
        (S.format_tokens, (999,), "999"),
        (S.format_tokens, (2500,), "2K"),
        (S.format_tokens, (1_250_000,), "1.2M"),
        (S.format_size, (1023,), "1023 B"),
        (S.format_size, (1536,), "1.5 KB"),
        (S.format_size, (3 * 1024**3,), "3.0 GB"),
        (S.format_seconds, (1.234,), "1.23s"),
        (S.py_strip, ("\u00a0\u3000 a b\t\n",), "a b"),
        (S.excerpt, ("x" * 300,), "x" * 220 + "..."),
        (S.normalized_text, (" a \n\t b ",), "a b"),
        (S.largest_number, ("read 5 of 20 sessions",), 20),
        (S.csv_list, ("a, ,b ,",), ["a", "b"]),
        (S.project_of_encoded_dir, ("-Users-ann-Documents-my-app",), "my-app"),
        (S.project_of_encoded_dir, ("-home-bob-x",), "x"),
        (S.project_of_encoded_dir, ("-home-bob",), "~home"),
        (S.timestamp_text, (1706000000000,), "2024-01-23T08:53:20+00:00"),
        (S.timestamp_text, (1706000000123,), "2024-01-23T08:53:20.123000+00:00"),
        (S.user_hash, ("alice",), "user_2bd806c9"),
        (S.masked, ("abcdefgh",), "***"),
        (S.masked, ("abcdefghij",), "abcd...ghij"),
        (S.json_pointer, ("/a", "b/c~d"), "/a/b~1c~0d"),
        (S.clean_text, ("\x1b[31mred\x1b[0m\tx  \ny ",), "red    x\ny"),
        (S.without_accents, ("Renée Ñandú e\u0301",), "Renee Nandu e"),
        (S.mixed_types, ("abcdef",), False),
        (S.mixed_types, ("abcDEF",), True),
    ],
)
def test_scalars(spark, function, args, expected):
    assert one(spark, function, *args) == expected


def test_project_of_path(spark):
    rows = spark.createDataFrame([("/a/b/c/",), ("C:\\x\\y",), (None,)], "p string").select(S.project_of_path(F.col("p"), "codex")).collect()
    assert [r[0] for r in rows] == ["codex:c", "codex:y", "codex:unknown"]


def test_entropy(spark):
    assert abs(one(spark, S.shannon_entropy, "aB3dE6gH9jK2mN5pQ8rS1tU4wX7yZ0c") - 4.954) < 1e-3
    assert one(spark, S.shannon_entropy, "aaaa") == 0


def test_set_fingerprint_knows_no_order(spark):
    rows = spark.createDataFrame([(["b", "a", "a"],), (["a", "b"],), (["ab"],)], "x array<string>").select(S.set_fingerprint(F.col("x"))).collect()
    assert rows[0] == rows[1] != rows[2]


@settings(max_examples=300, deadline=None)
@given(values, values)
def test_a_patch_turns_the_old_value_into_the_new(old, new):
    ops = J.patch(old, new)
    if not any(op["op"] == "replace_text" for op in ops):
        assert J.apply_patch(old, ops) == new
    assert (not ops) == (J.canonical(old) == J.canonical(new))


def test_patch_of_texts_and_blobs():
    assert J.patch({"a": "x\ny"}, {"a": "x\nz"})[0]["op"] == "replace_text"
    (op,) = J.patch({"a": "A" * 5000}, {"a": "B" * 6000})
    assert op["op"] == "replace_large_blob" and (op["old"]["length"], op["new"]["length"]) == (5000, 6000)
    assert J.patch(J.masked_originals({"originalFile": "a"}), J.masked_originals({"originalFile": "b"})) == []


def test_content_fingerprint_ignores_the_project():
    a = {"session_id": "1", "project": "x", "messages": [1]}
    assert J.content_fingerprint(a) == J.content_fingerprint({**a, "project": "y"}) != J.content_fingerprint({**a, "messages": []})


def test_yaml_reads_back():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(3)
    for text in ("a\nb", "a\nb\n", "a\n\n", "x: y", "yes", "12", "", " lead", "tab\tx", "é\nü", "# no", "- x", "a  \nb", "\x1b[0m\nx", "null"):
        value = {"k": text, "n": [1, None, {"t": text, "u": [text, True]}], "e": {}, "l": [], "r": rng.random()}
        assert yaml.safe_load(dump(value)) == value, text
    assert json.loads(json.dumps(value)) == value


def message(n, text="t", **more):
    return {"role": "user", "timestamp": f"T{n}", "content": text, **more}


def test_items_of_arrays_find_what_they_became():
    """A message in which one value changed gives that change, wherever its neighbours went."""
    call = {"tool": "shell", "input": {"command": "ls", "dir": "/"}, "output": {"text": "old", "code": 0}}
    other = {"tool": "shell", "input": {"command": "cat", "dir": "/"}, "output": {"text": "new", "code": 0}}
    assert J.patch({"messages": [message(0, tool_uses=[call])]}, {"messages": [message(0, tool_uses=[{**call, "output": {**call["output"], "raw": {"type": "text"}}}])]}) == [{"op": "add", "path": "/messages/0/tool_uses/0/output/raw", "value": {"type": "text"}}]
    before, after = [message(n) for n in range(20)], [message(n) for n in range(20)]
    after[19] = message(19, "new")
    assert J.patch({"messages": before}, {"messages": after}) == [{"op": "replace", "path": "/messages/19/content", "old": "t", "new": "new"}]
    assert J.patch([call], [other]) == [{"op": "replace", "path": "/0/input/command", "old": "ls", "new": "cat"}, {"op": "replace", "path": "/0/output/text", "old": "old", "new": "new"}]
    # One goes, one comes, one changes: by time, not by place.
    ops = J.patch([message(1), message(2), message(3)], [message(2, "x"), message(3, "y"), message(4)])
    assert [(o["op"], o["path"]) for o in ops] == [("remove", "/0"), ("replace", "/0/content"), ("replace", "/1/content"), ("add", "/2")]


def test_exact_partners_come_before_loose_ones():
    a, b = message(1, "a", thinking="p"), message(1, "b", thinking="p")
    ops = J.patch([a, b], [{**b, "thinking": "q"}, {**a, "thinking": "r"}])
    assert {(o["op"], o.get("old"), o.get("new")) for o in ops} == {("move", None, None), ("replace", "p", "q"), ("replace", "p", "r")}
    # Queues: equal keys pair in order.
    assert J.matched([a, a, b], [b, a, a]) == {0: 1, 1: 2, 2: 0}
    assert J.matched([a, "text"], [b]) is None and J.matched([message(1)], [message(2)]) == {}


MESSAGES = st.lists(st.builds(message, st.integers(0, 3), st.sampled_from(["a", "b", "c"]), thinking=st.sampled_from(["p", "q"]), tool_uses=st.lists(st.builds(lambda t, c: {"tool": t, "input": {"c": c}}, st.sampled_from("xy"), st.integers(0, 2)), max_size=3)), max_size=7)


@given(MESSAGES, MESSAGES)
@settings(max_examples=300, deadline=None)
def test_patches_of_messages_apply(old, new):
    assert J.apply_patch({"messages": old}, J.patch({"messages": old}, {"messages": new})) == {"messages": new}
