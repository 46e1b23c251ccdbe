"""The ingest loop on small folders, and event-time counts of a stream."""

import json

from tests.test_sources import ID, message, write

from ledgerloom.streaming.ingest import Archive, drain, event_counts


def test_sweep_is_idempotent_and_keeps_prose(spark, tmp_path):
    logs, home = tmp_path / "logs", Archive(spark, str(tmp_path / "archive"))
    write(logs / "a" / "s1.jsonl", [message("user", "one two"), message("assistant", "three", at="2026-07-15T00:00:09Z")])
    write(logs / "b" / "s1.jsonl", [message("user", "copy")])
    assert home.sweep(str(logs), "claude") == {"added": 1, "updated": 0, "unchanged": 0, "skipped": 1}
    row = home.table("sessions").collect()[0]
    assert row.session_id == ID and row.words == 5 and row.source_present == 1
    assert home.sweep(str(logs), "claude") == {"added": 0, "updated": 0, "unchanged": 0, "skipped": 0}
    write(logs / "a" / "s1.jsonl", [message("user", "one two"), message("assistant", "three four", at="2026-07-15T00:01:00Z")])
    assert home.sweep(str(logs), "claude")["updated"] == 1
    assert home.table("sessions").collect()[0].duration_s == 60
    for f in logs.rglob("*.jsonl"):
        f.unlink()
    write(logs / "c" / "other.jsonl", [message("user", "hi") | {"sessionId": "other"}])
    home.sweep(str(logs), "claude")
    kept = {r.session_id: r for r in home.table("sessions").collect()}
    assert kept[ID].source_present == 0 and "three four" in kept[ID].text and kept["other"].source_present == 1
    assert home.incomplete().count() == 0 and home.receipts().count() == 4


def test_same_content_twice_is_a_duplicate(spark, tmp_path):
    home = Archive(spark, str(tmp_path / "archive"))
    for folder in ("x", "y"):
        write(tmp_path / folder / "s.jsonl", [message("user", "same")])
        home.sweep(str(tmp_path / folder), "claude")
    ledger = [r for r in home.table("import_ledger").orderBy("started_at").collect() if r.finished_at]
    assert ledger[0].duplicate_of is None and ledger[1].duplicate_of == ledger[0].ledger_id and ledger[1].unchanged == 1


def state(home):
    """All tables but for what names a run."""
    stamps = {"ledger_id", "started_at", "finished_at", "updated_at", "ingested_at", "failed_at", "duplicate_of"}
    tables = {}
    for name in ("sessions", "session_files", "session_tools", "ingest_state", "failure_log"):
        rows = home.table(name)
        tables[name] = sorted(repr(tuple(r)) for r in rows.select([c for c in rows.columns if c not in stamps]).collect())
    done = home.table("import_ledger").where("finished_at IS NOT NULL")
    tables["import_ledger"] = sorted(repr(tuple(r)) for r in done.select("source_digest", "item_count", "added", "updated", "unchanged", "skipped", "outcome").collect())
    tables["import_items"] = sorted(repr(tuple(r)) for r in home.table("import_items").select("item_id", "disposition", "reason").collect())
    return tables


def test_a_batch_killed_anywhere_and_run_again_gives_equal_tables(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    write(logs / "a" / "s1.jsonl", [message("user", "one two"), "broken"])
    write(logs / "a" / "s2.jsonl", [message("user", "three") | {"sessionId": "second"}])
    whole = Archive(spark, str(tmp_path / "whole"))
    whole.sweep(str(logs), "claude")
    expected, plain = state(whole), Archive.write
    assert expected["failure_log"] and len(expected["sessions"]) == 2
    for k in range(1, 10):
        home, writes = Archive(spark, str(tmp_path / f"killed{k}")), [0]

        def killed(self, name, rows, number, k=k, writes=writes):
            writes[0] += 1
            if writes[0] == k:
                raise RuntimeError("killed")
            return plain(self, name, rows, number)

        monkeypatch.setattr(Archive, "write", killed)
        try:
            home.sweep(str(logs), "claude")
            died = False
        except RuntimeError:
            died = True
            assert home.table("sessions").count() == home.table("import_items").count() == home.table("ingest_state").count() == 0
        monkeypatch.setattr(Archive, "write", plain)
        assert died and home.incomplete().count() == (1 if k > 1 else 0)
        home.sweep(str(logs), "claude")
        assert state(home) == expected, k
    home.compact("sessions")
    assert state(home) == expected and len(home.commits.newest()[1]["sessions"]) == 1


def test_unchanged_prose_is_not_written_again(spark, tmp_path):
    logs, home = tmp_path / "logs", Archive(spark, str(tmp_path / "archive"))
    write(logs / "s1.jsonl", [message("user", "one two")])
    home.sweep(str(logs), "claude")
    write(logs / "s2.jsonl", [message("user", "other") | {"sessionId": "second"}])
    home.sweep(str(logs), "claude")
    parts = home.commits.newest()[1]["sessions"]
    assert [spark.read.parquet(p).count() for p in parts] == [1, 1] and home.table("sessions").count() == 2


def test_a_second_writer_of_the_same_number_fails(spark, tmp_path):
    import pytest

    from ledgerloom.operators.archive import Commits

    commits = Commits(spark, str(tmp_path / "c"))
    commits.commit(1, {"t": ["a"]})
    with pytest.raises(FileExistsError):
        commits.commit(1, {"t": ["b"]})
    assert commits.newest() == (1, {"t": ["a"]})


def test_queue_is_drained_once(spark, tmp_path):
    home = Archive(spark, str(tmp_path / "archive"))
    write(tmp_path / "t" / "s.jsonl", [message("user", "queued")])
    queue = tmp_path / "queue"
    queue.mkdir()
    (queue / "1.json").write_text(json.dumps({"v": 1, "kind": "session-end", "transcript_path": str(tmp_path / "t" / "s.jsonl")}))
    (queue / "2.json").write_text("nonsense")
    for _ in range(2):
        query = drain(spark, str(queue), home, str(tmp_path / "check"), str(tmp_path / "bad"))
        query.awaitTermination(120)
    assert [r.text for r in home.table("sessions").collect()] == ["[USER] queued"]
    assert [r.value for r in spark.read.text(str(tmp_path / "bad")).collect() if r.value] == ["nonsense"]
    assert home.receipts().count() == 1


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    events = spark.createDataFrame([(f"2026-01-01 0{h}:{m:02d}:00", "click" if m % 2 else "view", 1.0) for h in range(3) for m in range(0, 60, 7)], "ts string, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, event_counts(events).collect()))
