"""Every pN_ query on empty tables, on nulls and repeated rows, and with extra columns of clashing names."""

import datetime

import pytest

from ledgerloom.llm.queries import QUERIES

SESSIONS = "session_id string, source string, provenance string, title string, words int, duration_s double, text string, ingested_at timestamp_ntz, updated_at timestamp_ntz"
TABLES = {
    "sessions": SESSIONS,
    "documents": "doc_id long, text string, source string",
    "chunk_vectors": "session_id string, ordinal int, model string, dim int, vec array<float>",
    "eval_items": "item_id long, text string",
    "keep_targets": "source string, provenance string, keep_pct int",
}
NOW = datetime.datetime(2026, 5, 1)
LONG = "A sentence of six words here. " * 900
ROWS = {
    "sessions": [
        ("a", " Claude", "HUMAN", "Call back Hanneli Tarrowby re: it", 5, 3.5, LONG, NOW, NOW),
        ("a", "claude", "human", None, 9, 3.5, "older", NOW, datetime.datetime(2026, 1, 1)),
        ("b", "claude", None, "", None, None, None, None, None),
        ("c", "claude", "human", "x", -4, -1.0, "", NOW, NOW),
        ("d", None, "human", "x", 0, float("nan"), "z" * 20_000, NOW, NOW),
        (None, "claude", "human", "x", 7, 1e300, "mail a.b@corp.invalid now", NOW, NOW),
    ],
    "documents": [(1, None, None), (2, "", "s"), (3, "word " * 3_000, " S "), (4, "\n \n", "s"), (None, "cut in the midd", "s"), (5, "one two three four five six seven eight nine ten eleven twelve thirteen", "s")],
    "chunk_vectors": [("a", 0, "m", 2, [1.0, 0.0]), ("a", 1, "m", 2, [1.0, 0.001]), ("b", 0, "m", 2, None), ("b", 1, "m", 2, [0.0, 0.0]), ("e", 0, "m", 3, [1.0, 0.0, 0.0]), ("e", 1, "m", 3, [1.0, 0.0, 0.001]), ("b", None, "m", 2, [1.0, 1.0]), (None, 1, "m", 2, [1.0, 1.0]), ("c", 0, "m", None, [1.0, 1.0]), ("c", 0, "k", 2, [float("inf"), 1.0])],
    "eval_items": [(1, "ONE two, three four five six seven eight nine ten eleven twelve!"), (2, None), (3, ""), (None, "x"), (4, "short")],
    "keep_targets": [("claude", "human", 50), ("claude", "human", 50), ("claude", None, 10), (None, None, None), ("codex", "human", 10)],
}
CLASH = ["n", "rank", "_tie", "_row", "node", "id", "size", "length", "part", "container", "level", "cell", "line", "odds", "word", "h", "kind", "field", "piece", "cutoff", "slice", "_text", "value", "day", "metric"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    for name in ("empty", "nulls", "clash"):
        folder = tmp_path_factory.mktemp(name)
        for table, schema in TABLES.items():
            rows = [] if name == "empty" else ROWS[table] * 2
            frame = spark.createDataFrame(rows, schema)
            if name == "clash":
                frame = frame.selectExpr("*", *[f"'x' as `{c}`" for c in CLASH if c not in frame.columns])
            frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        made[name] = str(folder)
    return made


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, folders, name):
    got = QUERIES[name](spark, folders["empty"])
    rows = got.collect()
    assert rows == [] or name == "p6_fill"


@pytest.mark.parametrize("name", QUERIES)
def test_extra_columns_change_nothing(spark, folders, name):
    plain, more = (QUERIES[name](spark, folders[kind]) for kind in ("nulls", "clash"))
    assert plain.columns == more.columns
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, more.collect()))


def test_defined_results(spark, folders):
    got = lambda name: sorted(map(tuple, QUERIES[name](spark, folders["nulls"]).collect()))
    assert got("p1_found") == [("claude", "human", "a")]
    assert got("p2_found") == [("a",), ("d",)]
    assert got("p3_found") == [("a", "title", "person")]
    assert got("p4_found") == [("m", "a", 0, "a", 1), ("m", "e", 0, "e", 1)]
    assert got("p6_found") == [(3,)]
    assert got("p7_found") == [(5, 1)]


def test_every_session_comes_out_redacted(spark, folders):
    got = {r.session_id: (r.text, r.title) for r in QUERIES["p3_redacted"](spark, folders["nulls"]).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"][0] == LONG and got["a"][1] == "Call back [PERSON] re: it" and got["b"] == (None, "") and got["c"] == ("", "x")
