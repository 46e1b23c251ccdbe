"""Scalar functions on text, paths, labels and times, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space between words, in a form Java, RE2 and Python agree on.
BLANK = r"[\x{09}-\x{0d}\x{1c}-\x{1f}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Prefixes a router or provider puts before a model's name, and names always let through.
GEO_PREFIXES = ("us-gov.", "us.", "eu.", "apac.", "global.")
PROVIDER_PREFIXES = ("anthropic.", "anthropic/", "openai/", "bedrock/", "vertex_ai/", "vertex/", "azure/", "litellm/", "openrouter/")
MODEL_ALLOWED = "<synthetic>"
MODEL_HIDDEN = "custom/redacted"
MODEL_SAFE = r"^[A-Za-z0-9][A-Za-z0-9._:@\-\[\]]{0,63}$"
# Directories whose sessions programs start, and entry points that are programs.
TOOL_FOLDERS = ("/.local/state/", "/.cache/", "/Library/Caches/", "\\AppData\\Local\\", "/AppData/Local/")
TOOL_ENTRYPOINTS = ("sdk-cli", "sdk", "sdk-ts", "sdk-py")
# Escape sequences, control and invisible characters a label must not hold.
ANSI = r"\x1b(?:\[[0-9;:<=>?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}]"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def words(text: str | Column) -> Column:
    """The words of a text, cut at white space; null for null."""
    return F.filter(F.split(_col(text), BLANK + "+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null and blank texts."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def basename(path: str | Column) -> Column:
    """What follows the last slash; empty for null and for a path that ends in one."""
    return F.substring_index(F.coalesce(_col(path), F.lit("")), "/", -1)


def comparable_path(path: str | Column) -> Column:
    """A path as paths are compared: forward slashes, no ``.`` parts or doubled slashes, lower case."""
    slashed = F.regexp_replace(_col(path), r"\\", "/")
    single = F.regexp_replace(F.regexp_replace(slashed, r"/(\./)+", "/"), r"/{2,}", "/")
    return F.lower(F.regexp_replace(single, r"^\./|(?<=.)/$", ""))


def path_depth(path: str | Column) -> Column:
    """Number of parts of a path that are not empty or ``.``."""
    return F.size(F.filter(F.split(F.regexp_replace(_col(path), r"\\", "/"), "/"), lambda p: (p != "") & (p != ".")))


def path_tag(path: str | Column, salt: str) -> Column:
    """Eight hex digits that stand for a path and don't give it away."""
    plain = F.regexp_replace(F.regexp_replace(_col(path), r"\\", "/"), "/+$", "")
    return F.substr(F.sha2(F.concat(F.lit(salt), F.lit("\0"), plain).cast("binary"), 256), F.lit(1), F.lit(8))


def shard_of(identifier: str | Column, shards: int) -> Column:
    """A stable shard number: the first 8 bytes of SHA-256, unsigned, modulo ``shards``."""
    head = F.conv(F.substr(F.sha2(_col(identifier).cast("binary"), 256), F.lit(1), F.lit(16)), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(shards).cast("decimal(20,0)")).cast("int")


def model_name(model: str | Column) -> Column:
    """A model's plain name: routing prefixes off (four at most), anything that may name an account hidden; null for null and blank."""
    trimmed = F.btrim(_col(model), F.lit(" \t\r\n\x0b\x0c"))
    prefixes = "|".join(re.escape(p) for p in (*GEO_PREFIXES, *PROVIDER_PREFIXES))
    name = F.regexp_replace(trimmed, rf"(?i)^(?:{prefixes}){{1,4}}", "")
    low = F.lower(trimmed)
    hidden = low.contains("arn:") | low.contains("://") | low.contains("@") | trimmed.rlike(r"[0-9]{10,}") | (name == "") | name.contains("/") | ~name.rlike(MODEL_SAFE)
    return F.when((trimmed == "") | trimmed.isNull(), None).when(trimmed == MODEL_ALLOWED, trimmed).when(hidden, MODEL_HIDDEN).otherwise(name)


def safe_label(text: str | Column, limit: int = 120) -> Column:
    """One line without escapes, control or invisible characters, at most ``limit`` long with an ellipsis; empty for null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(_col(text), F.lit("")), ANSI, ""), CONTROL, ""), INVISIBLE, "")
    flat = F.btrim(F.regexp_replace(F.regexp_replace(bare, "\x1b", ""), BLANK + "+", " "), F.lit(" "))
    return F.when(F.char_length(flat) > limit, F.concat(F.rtrim(F.substr(flat, F.lit(1), F.lit(limit - 1))), F.lit("…"))).otherwise(flat)


def moment(text: str | Column) -> Column:
    """The time a text tells: ISO 8601 with or without an offset (UTC without), or seconds since 1970; else null."""
    value = F.btrim(_col(text), F.lit(" \t\r\n"))
    iso = F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}"), F.try_to_timestamp(value))
    seconds = F.when(value.rlike(r"^[0-9]{9,11}(\.[0-9]+)?$"), F.timestamp_micros((value.cast("double") * 1000000).cast("long")))
    return F.coalesce(iso, seconds)


def date_bounds(prefix: str) -> tuple[str, str]:
    """First and last moment of a year, month or day: ``2026``, ``2026-03`` or ``2026-03-14``; ValueError for anything else."""
    import calendar
    import datetime

    parts = prefix.strip().split("-")
    if not re.fullmatch(r"\d{4}(-\d{1,2}){0,2}", prefix.strip()):
        raise ValueError(f"not a date: {prefix!r}")
    year = int(parts[0])
    first_month = int(parts[1]) if len(parts) > 1 else 1
    last_month = int(parts[1]) if len(parts) > 1 else 12
    first_day = int(parts[2]) if len(parts) > 2 else 1
    first = datetime.date(year, first_month, first_day)
    last = datetime.date(year, last_month, int(parts[2]) if len(parts) > 2 else calendar.monthrange(year, last_month)[1])
    return f"{first}T00:00:00", f"{last}T23:59:59.999999"


def age_label(then: str | Column, now: str | Column) -> Column:
    """How long ago, as a person says it: just now, minutes, hours, yesterday, days; null for null, just now for the future."""
    seconds = F.unix_timestamp(_col(now)) - F.unix_timestamp(_col(then))
    whole = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds.isNull(), None).when(seconds < 90, "just now").when(seconds < 3600, F.concat(whole(60), F.lit("m ago"))).when(seconds < 86400, F.concat(whole(3600), F.lit("h ago"))).when(seconds < 2 * 86400, "yesterday").otherwise(F.concat(whole(86400), F.lit("d ago")))


def provenance(subagent: Column, entrypoint: Column, cwd: Column, user_turns: Column, duration_s: Column) -> Column:
    """Who held a session, told by its structure only: a subagent, a tool, or a human."""
    folder = F.coalesce(cwd, F.lit(""))
    by_folder = F.lit(False)
    for marker in TOOL_FOLDERS:
        by_folder = by_folder | folder.contains(marker)
    by_entry = F.coalesce(F.lower(entrypoint).isin(*TOOL_ENTRYPOINTS), F.lit(False))
    fast = F.coalesce((user_turns <= 1) & (duration_s < 2.0), F.lit(False))
    tool = by_entry | by_folder | F.coalesce(user_turns == 0, F.lit(False)) | fast
    return F.when(F.coalesce(subagent, F.lit(False)), "subagent").when(tool, "tool-invoked").otherwise("human")


def provenance_rules(subagent: Column, nested: Column, sidechain: Column, entrypoint_sdk: Column, non_interactive: Column, state_folder: Column, user_turns: Column, duration_s: Column) -> Column:
    """Every structural sign that fired, by name; ``default_human`` when none did."""
    fired = [(subagent, "subagent_path"), (nested & ~subagent, "nested_transcript_path"), (sidechain, "sidechain_flag"), (entrypoint_sdk, "entrypoint_sdk_cli"), (non_interactive, "originator_non_interactive"), (state_folder, "cwd_state_dir"), (user_turns == 0, "zero_user_turns"), ((user_turns == 1) & (duration_s < 2.0), "single_user_turn_under_2s")]
    rules = F.array_compact(F.array(*[F.when(F.coalesce(sign, F.lit(False)), name) for sign, name in fired]))
    return F.when(F.size(rules) == 0, F.array(F.lit("default_human"))).otherwise(rules)
