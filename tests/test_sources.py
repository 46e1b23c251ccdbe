"""Readers of transcripts, exports, prose files, queues and commits."""

import json
import zipfile

import pytest

from ledgerloom.sources import exports, others, transcripts

ID = "0b9c7f0e-1111-4222-8333-abcdefabcdef"


def write(path, records, tail="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + tail)


def message(role, content, **more):
    return {"type": role, "sessionId": ID, "timestamp": more.pop("at", "2026-07-15T00:00:00Z"), "cwd": "/tmp/project", "gitBranch": "main", "message": {"role": role, "content": content, **more}}


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_claude_transcript(spark, tmp_path):
    records = [
        message("user", "hello there"),
        "",
        "{broken",
        "[1, 2, 3]",
        {"type": "user", "sessionId": ID},
        message("assistant", [{"type": "text", "text": "fine"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/a/b.py"}}, {"type": "tool_use", "name": "Bash", "input": {}}, {"type": "tool_use", "name": "Read", "input": {"file_path": "/a/b.py"}}], model="m-1", usage={"input_tokens": 10, "output_tokens": 5}, at="2026-07-15T00:05:00Z"),
        message("user", [{"type": "tool_result"}]),
        message("user", 7),
    ]
    write(tmp_path / "p" / f"{ID}.jsonl", records, tail='\n{"type": "user", "half')
    write(tmp_path / "p" / "journal.jsonl", records)
    row = one(transcripts.parse_claude(transcripts.discover(spark, str(tmp_path), "claude")))
    assert row.session_id == ID and row.provenance == "human" and row.parent_id is None
    assert row.text == "[USER] hello there\n\n[ASSISTANT] fine" and row.words == 5
    assert (row.user_turns, row.assistant_turns, row.tool_uses, row.tool_results) == (2, 1, 3, 1)
    assert row.tools == {"Read": 2, "Bash": 1} and row.files == ["/a/b.py"]
    assert row.failures == {"malformed_json": 1, "not_an_object": 1, "missing_message": 1, "unreadable_content": 1}
    assert (row.tokens, row.model, row.cwd, row.branch) == (15, "m-1", "/tmp/project", "main")
    assert row.started_at == "2026-07-15T00:00:00Z" and row.duration_s == 0.0


def test_subagent_and_tool_provenance(spark, tmp_path):
    write(tmp_path / "parent-1" / "subagents" / "agent-7.jsonl", [message("user", "go")])
    write(tmp_path / "x.jsonl", [message("user", "go") | {"entrypoint": "sdk-cli"}])
    rows = {r.session_id: r for r in transcripts.parse_claude(transcripts.discover(spark, str(tmp_path), "claude")).collect()}
    assert rows["agent-7"].provenance == "subagent" and rows["agent-7"].parent_id == "parent-1"
    assert rows[ID].provenance == "tool-invoked"


def test_empty_and_garbage_files(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "bad.jsonl").write_bytes(b"\xff\xfe\n{}\n")
    rows = transcripts.parse_claude(transcripts.discover(spark, str(tmp_path), "claude")).collect()
    assert [(r.session_id, r.text, r.words) for r in rows] == [("bad", "", 0)]


def test_codex_rollout(spark, tmp_path):
    records = [
        {"timestamp": "2026-07-15T00:00:00Z", "type": "session_meta", "payload": {"cwd": "/w/repo"}},
        {"timestamp": "2026-07-15T00:00:01Z", "type": "turn_context", "cwd": "/other", "model": "c-1"},
        {"timestamp": "2026-07-15T00:00:02Z", "type": "event_msg", "payload": {"type": "user_message", "message": "do it"}},
        {"timestamp": "2026-07-15T00:00:09Z", "type": "event_msg", "payload": {"type": "agent_message", "message": "done"}},
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "  "}},
        {"type": "event_msg", "payload": {"type": "token_count", "input_tokens": 3, "output_tokens": 4, "total_tokens": 50}},
        {"type": "response_item", "payload": {"type": "exec_command"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell"}},
    ]
    write(tmp_path / f"rollout-2026-07-15T00-00-00-{ID}.jsonl", records)
    row = one(transcripts.parse_codex(transcripts.discover(spark, str(tmp_path), "codex")))
    assert row.session_id == ID and row.cwd == "/w/repo" and row.model == "c-1"
    assert row.text == "[USER] do it\n\n[ASSISTANT] done" and row.tokens == 50 and row.duration_s == 9.0
    assert row.tools == {"exec": 1, "shell": 1}


CLAUDE = [
    {"uuid": "a", "name": "First", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-02T00:00:00Z", "chat_messages": [{"sender": "human", "text": "hi", "content": [{"type": "text", "text": "again"}], "attachments": [{"file_name": "n.txt", "extracted_content": "x" * 40_000}]}, {"sender": "assistant", "text": "yes"}]},
    {"uuid": "b", "updated_at": "2026-01-02", "chat_messages": [{"sender": "human", "content": [{"type": "image"}]}]},
    {"uuid": "c", "updated_at": "2026-01-02", "chat_messages": [{"sender": "bot", "text": "x"}]},
    {"uuid": "d", "updated_at": "2026-01-02", "chat_messages": []},
    {"uuid": "e", "chat_messages": []},
    {"name": "no id"},
    "text",
]


def test_claude_export(spark, tmp_path):
    (tmp_path / "conversations.json").write_text(json.dumps(CLAUDE))
    rows = {r.session_id: r for r in exports.read(spark, str(tmp_path)).collect()}
    assert len(rows) == len(CLAUDE)
    first = rows["a"]
    assert first.reason is None and first.title == "First" and (first.user_turns, first.assistant_turns) == (1, 1)
    parts = first.text.split("\n\n")
    assert parts[:2] == ["[USER] hi", "[USER] again"] and parts[2].startswith("[USER ATTACHMENT n.txt] x") and parts[3] == "[ASSISTANT] yes"
    assert len(parts[2]) == len("[USER ATTACHMENT n.txt] ") + 30_000
    assert {k: r.reason for k, r in rows.items() if k != "a"} == {"b": "unsupported-content-type", "c": "unsupported-sender-role", "d": "no-content", "e": "missing-timestamp", "item#5": "missing-item-id", "item#6": "unknown-schema"}


def test_chatgpt_export_in_zip(spark, tmp_path):
    node = lambda role, text, at: {"message": {"author": {"role": role}, "create_time": at, "content": {"parts": [text]}}}
    chats = [{"id": "q", "title": "T", "create_time": 1700000000.0, "update_time": 1700000100.5, "mapping": {"n1": node("assistant", "second", 2.0), "n2": node("user", "first", 1.0), "n3": {"message": None}, "n4": node("user", "undated", None), "n5": node("system", "s", 0.5)}}]
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("deep/er/conversations.json", "[]")
        z.writestr("top/conversations.json", json.dumps(chats))
    row = one(exports.read(spark, str(tmp_path / "export.zip")))
    assert row.text == "[USER] first\n\n[ASSISTANT] second\n\n[USER] undated"
    assert row.session_id == "q" and row.title == "T" and row.ended_at == "1700000100.5" and row.reason is None
    assert [r.path.rsplit("/", 1)[1] for r in exports.find(spark, str(tmp_path)).collect()] == ["export.zip"]


def test_export_that_is_none(spark, tmp_path):
    (tmp_path / "conversations.json").write_text('{"a": 1}')
    with pytest.raises(exports.ExportReadError):
        exports.load(spark, str(tmp_path / "conversations.json"))


def test_prose_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# session: s1\n# session: other\n# kind: session\n# turns: user=3 assistant=242\n# start: 2026-01-01T00:00:00Z\n# end: 2026-01-01T00:01:00Z\n\n[USER 1] hello\n# not a header")
    (tmp_path / "b.txt").write_text("# kind: memory\n# project: notes\n\nremember this")
    (tmp_path / "c.txt").write_text("no header")
    (tmp_path / "d.txt").write_text("# session: s4\n\n  ")
    rows = {r.session_id: r for r in others.read_prose(spark, str(tmp_path)).collect()}
    assert rows["s1"].text == "[USER 1] hello\n# not a header" and rows["s1"].user_turns == 3 and rows["s1"].assistant_turns == 242 and rows["s1"].duration_s == 60
    assert rows["memory:notes"].source == "claude-memory" and rows["memory:notes"].provenance == "human"
    assert rows["c"].reason == "unknown-schema" and rows["s4"].reason == "no-content"


def test_summaries(spark, tmp_path):
    (tmp_path / "s1.md").write_text('---\n**topic:** "The queue"\noutcome: resolved\nkeywords: [a, b, "c"]\n---\nbody')
    row = one(others.read_summaries(spark, str(tmp_path)))
    assert (row.session_id, row.topic, row.outcome, row.keywords) == ("s1", "The queue", "fixed", ["a", "b", "c"])


def test_queue(spark, tmp_path):
    for name, body in (("1.json", json.dumps({"v": 1, "kind": "session-end", "transcript_path": "/t"})), ("2.json", "nonsense"), ("3.json", "{}")):
        (tmp_path / name).write_text(body)
    jobs = others.read_queue(spark, str(tmp_path))
    assert [r.ok for r in jobs.collect()] == [True, False, False]
    state = one(others.queue_state(jobs))
    assert (state.pending, state.bad) == (1, 2)


def test_commits(spark, tmp_path):
    lines = spark.createDataFrame([("abc\x1f2026-01-01T10:00:00+02:00\x1fX\x1fFix: it",), ("bad",)], "value string")
    row = one(others.parse_commits(lines))
    assert row.commit_id == "abc" and row.at.isoformat() == "2026-01-01T08:00:00" and row.subject == "Fix: it"
    assert others.read_commits(spark, str(tmp_path), "f").count() == 0


def plugged():
    yield {"session_id": "1", "text": "hi"}


def test_plugged_source(spark):
    spark.dataSource.register(others.HistorySource)
    rows = spark.read.format("history").option("module", "tests.test_sources").option("attribute", "plugged").option("prefix", "plugin:x:").load().collect()
    assert [(r.session_id, r.text) for r in rows] == [("plugin:x:1", "hi")]
