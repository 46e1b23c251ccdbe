"""Exports of hosted chats: one JSON array of conversations, plain or in a zip archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import word_count
from ledgerloom.sources.transcripts import text_at

# The file an export is in, and how much of an attachment is kept.
NAME = "conversations.json"
ATTACHMENT_CHARS = 30_000


class ExportReadError(Exception):
    """The export is missing, can't be opened or isn't a JSON array."""


def unpack(content: bytes) -> bytes | None:
    """The conversations of a zip archive: of several files of the name the one highest up, then with the shortest path; else the bytes as they are."""
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        found = [n for n in archive.namelist() if n.rsplit("/", 1)[-1] == NAME]
        return archive.read(min(found, key=lambda n: (n.count("/"), len(n), n))) if found else None


def load(spark: SparkSession, path: str) -> DataFrame:
    """item (from 0), v: the conversations of the export at ``path``, a JSON file, a zip, or a folder that holds one."""
    files = spark.read.format("binaryFile").load(path)
    if "." not in path.rstrip("/").rsplit("/", 1)[-1]:
        files = spark.read.format("binaryFile").option("pathGlobFilter", NAME).load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inside = [unpack(c) for c in batch["content"]]
            yield pd.DataFrame({"text": [b.decode("utf-8", "replace") if b is not None else None for b in inside]})

    parsed = files.select("content").mapInPandas(read, "text string").select(F.try_parse_json("text").alias("v"))
    listed = parsed.withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False)))
    if not listed.where("ok").limit(1).count():
        raise ExportReadError(path)
    return listed.where("ok").select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("item", "v"))


def detect(items: DataFrame) -> str | None:
    """Which kind of export it is, told by the first twenty items' keys."""
    has = lambda key: F.coalesce(F.max(F.try_variant_get("v", f"$.{key}", "variant").isNotNull()), F.lit(False))
    seen = items.where("item < 20").agg(has("mapping").alias("mapping"), (has("chat_messages") | has("uuid")).alias("chat")).first()
    return "chatgpt-export" if seen["mapping"] else "claude-export" if seen["chat"] else None


def spoken(text: Column, tag: Column) -> Column:
    return F.when(F.btrim(text, F.lit(" \t\r\n")) != "", F.concat(F.lit("["), tag, F.lit("] "), text))


def as_list(v: Column, path: str) -> Column:
    """The array at a path; empty for anything else."""
    at = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(at).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def raw_at(v: Column, path: str) -> Column:
    """The value at a path as text, numbers as they are written; null for a missing one."""
    return F.try_variant_get(v, path, "string")


def compact(parts: Column) -> Column:
    return F.filter(parts, lambda p: p.isNotNull())


def parse_claude(items: DataFrame) -> DataFrame:
    """One row an item: session columns, or ``reason`` why it was skipped; never both and never neither."""
    v = F.col("v")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    sender = lambda m: F.coalesce(text_at(m, "$.sender"), F.lit(""))
    tag = lambda m: F.when(sender(m) == "human", "USER").otherwise("ASSISTANT")
    messages = F.filter(as_list(v, "$.chat_messages"), lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    known = F.filter(messages, lambda m: sender(m).isin("human", "assistant"))
    is_text = lambda b: F.coalesce(text_at(b, "$.type") == "text", F.lit(False))

    def parts(m: Column) -> Column:
        blocks = F.transform(F.filter(as_list(m, "$.content"), is_text), lambda b: spoken(text_at(b, "$.text"), tag(m)))
        kept = lambda a: F.substr(text_at(a, "$.extracted_content"), F.lit(1), F.lit(ATTACHMENT_CHARS))
        attached = F.transform(as_list(m, "$.attachments"), lambda a: F.when(F.btrim(kept(a), F.lit(" \t\r\n")) != "", F.concat(F.lit("["), tag(m), F.lit(" ATTACHMENT "), F.coalesce(text_at(a, "$.file_name"), F.lit("")), F.lit("] "), kept(a))))
        return compact(F.concat(F.array(spoken(text_at(m, "$.text"), tag(m))), blocks, attached))

    said = F.flatten(F.transform(known, parts))
    odd_content = F.exists(known, lambda m: F.exists(as_list(m, "$.content"), lambda b: ~is_text(b)))
    return conclude(items, is_object, raw_at(v, "$.uuid"), raw_at(v, "$.created_at"), raw_at(v, "$.updated_at"), text_at(v, "$.name"), said, odd_content, F.size(known) < F.size(messages), F.size(F.filter(known, lambda m: sender(m) == "human")), F.size(F.filter(known, lambda m: sender(m) == "assistant")), "claude-cloud")


def parse_chatgpt(items: DataFrame) -> DataFrame:
    """As parse_claude. The graph of messages is flattened by creation time, messages without one last, in the order of the file."""
    v = F.col("v")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    mapping = F.try_variant_get(v, "$.mapping", "map<string,variant>")
    nodes = F.coalesce(F.map_values(mapping), F.array().cast("array<variant>"))
    inside = F.filter(F.transform(nodes, lambda n: F.try_variant_get(n, "$.message", "variant")), lambda m: F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)))
    role = lambda m: F.coalesce(text_at(m, "$.author.role"), F.lit(""))
    tag = lambda m: F.when(role(m) == "user", "USER").otherwise("ASSISTANT")
    is_text = lambda p: F.coalesce(F.schema_of_variant(p) == "STRING", F.lit(False))
    # what is needed of a message, as plain values, so that messages can be sorted
    plain = lambda m, i: F.struct(F.coalesce(F.try_variant_get(m, "$.create_time", "double"), F.lit(float("inf"))).alias("at"), i.alias("place"), role(m).alias("role"), compact(F.transform(F.filter(as_list(m, "$.content.parts"), is_text), lambda p: spoken(F.try_variant_get(p, "$", "string"), tag(m)))).alias("parts"), F.exists(as_list(m, "$.content.parts"), lambda p: ~is_text(p)).alias("odd"))
    messages = F.array_sort(F.transform(inside, plain))
    known = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    said = F.flatten(F.transform(known, lambda m: m["parts"]))
    identity = F.coalesce(text_at(v, "$.id"), text_at(v, "$.conversation_id"), text_at(v, "$.uuid"))
    return conclude(items, is_object, identity, F.coalesce(raw_at(v, "$.create_time"), raw_at(v, "$.created_at")), F.coalesce(raw_at(v, "$.update_time"), raw_at(v, "$.updated_at")), F.coalesce(text_at(v, "$.title"), text_at(v, "$.name")), said, F.exists(known, lambda m: m["odd"]), F.size(known) < F.size(messages), F.size(F.filter(known, lambda m: m["role"] == "user")), F.size(F.filter(known, lambda m: m["role"] == "assistant")), "chatgpt-cloud")


def conclude(items: DataFrame, is_object: Column, identity: Column, created: Column, updated: Column, title: Column, said: Column, odd_content: Column, odd_role: Column, user_turns: Column, assistant_turns: Column, source: str) -> DataFrame:
    """Session columns or the first reason against an item."""
    got = items.select("item", is_object.alias("_object"), F.nullif(identity, F.lit("")).alias("_id"), created.alias("started_at"), updated.alias("ended_at"), title.alias("title"), said.alias("_said"), odd_content.alias("_content"), odd_role.alias("_role"), user_turns.alias("user_turns"), assistant_turns.alias("assistant_turns"))
    empty = F.when(F.col("_content"), "unsupported-content-type").when(F.col("_role"), "unsupported-sender-role").otherwise("no-content")
    reason = F.when(~F.coalesce("_object", F.lit(False)), "unknown-schema").when(F.col("_id").isNull(), "missing-item-id").when(F.col("ended_at").isNull(), "missing-timestamp").when(F.size("_said") == 0, empty)
    text = F.array_join("_said", "\n\n")
    return got.select(F.coalesce("_id", F.concat(F.lit("item#"), F.col("item").cast("string"))).alias("session_id"), reason.alias("reason"), F.lit(source).alias("source"), F.lit("human").alias("provenance"), "title", "started_at", "ended_at", text.alias("text"), "user_turns", "assistant_turns", word_count(text).alias("words"))


PARSERS = {"claude-export": parse_claude, "chatgpt-export": parse_chatgpt}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The conversations of an export of either kind."""
    items = load(spark, path)
    kind = detect(items)
    if kind is None:
        raise ExportReadError(f"neither kind of export: {path}")
    return PARSERS[kind](items)


def find(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified of what may be exports directly in a folder, the newest first."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified"))
    return files.where(F.lower("path").endswith(".zip") | F.col("path").endswith("/" + NAME)).orderBy(F.desc("modified"), "path")
