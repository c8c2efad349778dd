import json

import pytest

from memloom.functions import jsonx
from memloom.operators import extract, memory
from memloom.memory import ConversationMemory
from memloom.sources import memory_files, models
from memloom.streaming.memory_stream import kept_rows, merge_stream
from test_memory import random_patches


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('[{"a": 1}]', [{"a": 1}]), ('x ```json\n[1]\n``` y', [1]), ('{"n": 1, "p": [2], "q": [3]}', [2]), ('{"n": 1}', None), ('Sure [1, 2,] ok', [1, 2]), ('[“a”]', ["a"]),
        ('say [["x]", 1], "\\"]"] end', [["x]", 1], '"]']), ("[1, 2", None), ("none", None), ("", None), (None, None), ("5", None),
    ],
)
def test_parse(raw, want):
    assert jsonx.parse_array(raw) == want


def test_items(spark):
    reply = json.dumps([{"type": "Constraints", "payload": "A  b", "patch_id": "z", "dependencies": None}, {"type": "slot", "payload": "a B", "patch_id": "z"}, {"type": "entities", "payload": "q", "patch_id": "z"}, {"type": "code", "payload": "c" * 500, "patch_id": "z", "dependencies": ["x", 3, 2.5, {"y": 1}, True]}, 7, {"type": "code"}])
    df = spark.createDataFrame([(1, 4, reply), (1, 5, "junk"), (2, 0, None), (2, 1, "[]")], "conv_id BIGINT, turn_index INT, llm_response STRING")
    got = {r.patch_id: r for r in extract.extract_items(df).collect()}
    assert {k: (r.patch_type, r.payload[:5], r.dependencies) for k, r in got.items()} == {"p4_0": ("constraint", "A b", []), "p4_1": ("code", "ccccc", ["x", "3", "True"])}
    assert len(got["p4_1"].payload) == 200
    assert {(r.conv_id, r.turn_index) for r in extract.extraction_errors(df).collect()} == {(1, 5), (2, 0)}


def test_save_load(spark, patches_of, tmp_path):
    m = memory.memory_rows(patches_of(random_patches(5, 40)))
    path = str(tmp_path / "saved")
    memory_files.save_memory(m, path)
    back = memory_files.load_memory(spark, path)
    cols = ["conv_id", "patch_id", "turn_index", "patch_type", "payload"]
    assert {tuple(r) for r in back.select(*cols).collect()} == {tuple(r) for r in m.select(*cols).collect()}
    with open(tmp_path / "saved" / "part-bad.json", "w") as f:
        f.write("{broken\n")
    assert memory_files.load_memory(spark, path).count() == m.count()
    with pytest.raises(Exception, match="(?i)malformed"):
        memory_files.load_memory(spark, path, strict=True).collect()


def test_memory_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": "1", "budget": 9, "turn_index": 3, "patches": [{"patch_id": "a", "turn_index": 0, "patch_type": "slot", "payload": "x", "dependencies": ["b"]}, {"patch_id": "b"}]}, indent=1))
    rows = memory_files.load_memory_file(spark, str(tmp_path / "m.json")).collect()
    assert [(r.pos, r.patch_id, r.dependencies, r.budget) for r in rows] == [(0, "a", ["b"], 9), (1, "b", None, 9)]


def test_models(spark):
    df = spark.createDataFrame([("small-chat-8b", 0), ("llama-70b-versatile", 1), ("llama-guard-70b", 2), ("gpt-120b", 3), ("whisper-chat", 4)], "model_id STRING, pos INT")
    assert models.pick_model(df) == "llama-70b-versatile"
    assert models.pick_model(df, ["absent", "gpt-120b"]) == "gpt-120b"


def test_calls(spark):
    def client():
        seen = {}

        def ask(prompt, text, room):
            turn = int(text.split("Turn ")[1].split(":")[0])
            seen[turn] = seen.get(turn, 0) + 1
            if turn == 1 and seen[turn] < 3:
                raise OSError("down")
            return "" if turn == 2 else f"[{room}]"

        return ask

    turns = spark.createDataFrame([(1, t, "hi", "") for t in range(3)], "conv_id BIGINT, turn_index INT, text STRING, context STRING").coalesce(1)
    got = {r.turn_index: (r.llm_response, r.attempts, r.error) for r in models.call_model(turns, client, "p", on_error="skip", wait=(0,)).collect()}
    assert got == {0: ("[2000]", 1, None), 1: ("[2000]", 3, None), 2: (None, 3, "empty reply")}
    with pytest.raises(Exception, match="no reply for turn 2"):
        models.call_model(turns, client, "p", wait=(0,)).collect()


def test_stream_equals_batch(spark, patches_of, tmp_path):
    m = memory.memory_rows(patches_of(random_patches(8, 120)))
    for part in range(3):  # in the order of turns
        m.where(f"turn_index >= {part * 4} AND turn_index < {part * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = merge_stream(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    kept = {(r.conv_id, r.row_id) for r in kept_rows(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert kept == {(r.conv_id, r.row_id) for r in memory.merge_memory(m).where("kept").collect()}


def test_stream_cells(spark, patches_of, tmp_path):
    m = memory.memory_rows(patches_of([r | {"conv_id": (1 << 60) + r["conv_id"]} for r in random_patches(8, 120)]))
    assert m.selectExpr("count(DISTINCT conv_id, substring_index(slot_key, '::', -1))").first()[0] > 6

    def run(cells):
        stream = merge_stream(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), cells=cells)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    for part in range(3):  # groups share a cell and come back in later batches
        m.where(f"turn_index >= {part * 4} AND turn_index < {part * 4 + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert run(3) <= 3
    kept = {(r.conv_id, r.row_id) for r in kept_rows(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert kept == {(r.conv_id, r.row_id) for r in memory.merge_memory(m).where("kept").collect()}
    m.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="made with 3 cells"):
        run(1)


def test_conversation_memory(spark, tmp_path):
    def reply(*items):
        return json.dumps([{"type": t, "payload": p, "patch_id": "x"} for t, p in items])

    turns = [(1, 0, "user", "Fee is 0.5%", reply(("constraint", "max fee 0.5%"), ("slot", "taxi.to = north"))), (1, 1, "user", "Fee is 0.3%", reply(("constraint", "max fee 0.3%"))), (2, 0, "user", "hm", "junk")]
    schema = "conv_id BIGINT, turn_index INT, role STRING, text STRING, llm_response STRING"
    m = ConversationMemory(spark)
    for t in (turns[:1], turns[1:]):  # in two batches
        m.add_turns(spark.createDataFrame(t, schema))
    assert {r.payload for r in m.all_patches.collect()} == {"max fee 0.3%", "taxi.to = north"}
    assert [r.payload for r in m.critical_patches.collect()] == ["max fee 0.3%"]
    assert [(r.conv_id, r.error_type) for r in m.error_log.collect()] == [(2, "parse_failure")]
    assert m.stats().first().context_built is False
    m.set_budget(100)
    ctx = m.get_context().first()
    assert ctx.context == "[CON] max fee 0.3%\n[SLOT] taxi.to = north" and ctx.budget == 100
    s = m.stats().first()
    assert (s.crr, s.context_built, s.conversation_tokens) == (100.0, True, 12)
    m.save(str(tmp_path / "s"))
    other = ConversationMemory(spark)
    other.load(str(tmp_path / "s"))
    other.load(str(tmp_path / "s"))
    assert other.all_patches.count() == 2
    m.reset()
    assert m.all_patches.count() == 0
    with pytest.raises(RuntimeError):
        m.add_turns(spark.createDataFrame(turns, schema).drop("llm_response"))

    def client():
        return lambda prompt, text, room: reply(("code", "use lib " + text[5]))

    auto = ConversationMemory(spark, client=client)
    auto.add_turns(spark.createDataFrame(turns, schema).drop("llm_response"))
    assert auto.all_patches.count() == 3


def test_calls_are_counted(spark):
    def client():
        asked = []

        def ask(prompt, text, room):
            asked.append(text)
            if len(asked) == 1:
                raise OSError("busy")
            return json.dumps([{"type": "code", "payload": "use lib " + text[5], "patch_id": "x"}])

        return ask

    m = ConversationMemory(spark, client=client)
    for turn in range(2):
        m.add_turns(spark.createDataFrame([(1, turn, "user", "hm")], "conv_id BIGINT, turn_index INT, role STRING, text STRING"))
    s = m.stats().first()
    assert (s.llm_calls, s.llm_errors) == (4, 2)
