"""Answers of a language model checked and narrowed to facets, and the lists kept as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes, the one for anything else, and the lengths facets are cut to.
OUTCOMES = ("fixed", "abandoned", "ongoing", "exploratory")
UNCLEAR = "ongoing"
TOPIC, SUMMARY, ITEM, ITEMS = 500, 4000, 300, 12
LISTS = ("decisions", "errors", "artifacts", "entities")
SPACE = " \t\r\n\x0b\x0c"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _type(value: Column) -> Column:
    """The kind of a JSON value: STRING, BIGINT, ARRAY<...>, OBJECT<...>, VOID for null; null where there is none."""
    return F.schema_of_variant(value)


def _at(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _item(value: Column) -> Column:
    """The text of a list's item: strings and numbers as they are, truth values by name, nulls null."""
    kind = _type(value)
    return F.when(kind == "BOOLEAN", F.initcap(_string(value))).when(kind != "VOID", _string(value))


def _nested(value: Column) -> Column:
    """Whether an item is a list or an object itself."""
    return _type(value).rlike("^(ARRAY|OBJECT)")


def parse_facets(answer: str | Column) -> Column:
    """STRUCT of topic, outcome, summary, the lists and ``failure``; where an answer is refused, ``failure`` says why and the rest is null.

    The whole answer must be one JSON object, but for a fence around it. Refused are, in this order,
    what is no JSON (also the empty answer and objects with a key twice), no object, has no topic,
    or has a field of the wrong type. Outcomes of other words are narrowed to the unclear one; a
    string in place of a list is a list of one; nulls and blanks in lists are left out.
    """
    answer = F.col(answer) if isinstance(answer, str) else answer
    bare = _strip(F.regexp_replace(_strip(F.coalesce(answer, F.lit(""))), r"(?is)\A```(?:json)?(.*?)(?:```)?\z", "$1"))

    def checked(document: Column) -> Column:
        topic, outcome, summary = (_at(document, name) for name in ("topic", "outcome", "summary"))
        lists = {name: _at(document, name) for name in LISTS}
        items = {name: F.slice(F.try_variant_get(value, "$", "array<variant>"), 1, ITEMS) for name, value in lists.items()}
        wrong = (_type(outcome) != "STRING") | outcome.isNull() | F.coalesce(_type(summary) != "STRING", F.lit(False))
        for name, value in lists.items():
            fits = value.isNull() | _type(value).isin("VOID", "STRING") | _type(value).startswith("ARRAY")
            wrong = wrong | ~fits | F.coalesce(F.exists(items[name], _nested), F.lit(False))
        reason = F.when(document.isNull(), "invalid-json").when(~_type(document).startswith("OBJECT"), "not-an-object")
        reason = reason.when(topic.isNull() | (_type(topic) != "STRING") | (_strip(_string(topic)) == ""), "missing-topic").when(wrong, "wrong-type")

        def texts(name: str) -> Column:
            alone = F.filter(F.array(_strip(_string(lists[name]))), lambda x: x != "")
            several = F.transform(F.filter(F.transform(items[name], lambda x: _strip(_item(x))), lambda x: x.isNotNull() & (x != "")), lambda x: F.substr(x, F.lit(1), F.lit(ITEM)))
            none = F.array().cast("array<string>")
            return F.when(_type(lists[name]) == "STRING", alone).otherwise(F.coalesce(several, none))

        said = F.lower(_strip(_string(outcome)))
        fields = {
            "topic": F.substr(_strip(_string(topic)), F.lit(1), F.lit(TOPIC)),
            "outcome": F.when(said.isin(*OUTCOMES), said).otherwise(UNCLEAR),
            "summary": F.coalesce(F.substr(_strip(_string(summary)), F.lit(1), F.lit(SUMMARY)), F.lit("")),
            **{name: texts(name) for name in LISTS},
        }
        return F.struct(*[F.when(reason.isNull(), value).alias(name) for name, value in fields.items()], reason.alias("failure"))

    # a list of one binds the document to a variable, so that it is parsed once
    return F.transform(F.array(F.try_parse_json(bare)), checked)[0]


def listed(facets_json: str | Column, name: str) -> Column:
    """The strings of one list of a facets document; empty for null, malformed JSON or another type."""
    column = F.col(facets_json) if isinstance(facets_json, str) else facets_json
    got = F.from_json(F.get_json_object(column, f"$.{name}"), "array<string>")
    return F.coalesce(F.filter(got, lambda x: x.isNotNull() & (F.btrim(x) != "")), F.array().cast("array<string>"))
