"""Messages reshaped for training and for the wire: column expressions over variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonx import items
from . import jsonx

ROLES = ["system", "user", "assistant", "tool"]


def _sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def content_text(v: Column) -> Column:
    """A message's content as text: a string as it is, anything else as JSON with sorted keys."""
    return F.coalesce(jsonx.string(v, "$.content"), F.to_json(_sub(v, "$.content")))


def chat(v: Column) -> Column:
    """One message (variant) as role, content, tool_calls, tool_call_id, name; an unknown role raises."""
    role = jsonx.string(v, "$.role")
    made = F.transform(items(v, "$.toolCalls"), lambda c: F.struct(jsonx.string(c, "$.id").alias("id"), F.lit("function").alias("type"), jsonx.string(c, "$.name").alias("name"), F.to_json(_sub(c, "$.arguments")).alias("arguments")))
    known = F.when(role.isin(ROLES), role).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("none")))))
    return F.struct(
        known.alias("role"),
        F.when(made.isNotNull(), "").otherwise(content_text(v)).alias("content"),
        made.alias("tool_calls"),
        F.when(role == "tool", jsonx.string(v, "$.toolCallId")).alias("tool_call_id"),
        F.when(role == "tool", jsonx.string(v, "$.name")).alias("name"),
    )


def training_conversation(trace: Column) -> Column:
    """A trace (JSON text) as an array of chat messages."""
    return F.transform(items(jsonx.variant(trace), "$.messages"), chat)


def compact(trace: Column) -> Column:
    """A trace for review: its id, first axis, intent and what follows the intent, as JSON."""
    v = jsonx.variant(trace)
    m = items(v, "$.messages")
    later = F.transform(F.slice(m, F.lit(3), F.greatest(F.size(m) - 2, F.lit(0))), lambda x: F.to_json(x))
    return F.concat(
        F.lit('{"traceId":'), F.to_json(_sub(v, "$.traceId")), F.lit(',"axis":'), F.to_json(_sub(v, "$.axes[0]")), F.lit(',"intent":'), F.to_json(_sub(v, "$.messages[1].content")), F.lit(',"messages":['), F.array_join(later, ","), F.lit("]}")
    )


def tool_declarations(tools: Column) -> Column:
    """Tool declarations (JSON text, an array of Name, Description, Parameters) as function declarations."""
    return F.transform(items(jsonx.variant(tools), "$"), lambda t: F.struct(F.lit("function").alias("type"), F.struct(jsonx.string(t, "$.Name").alias("name"), jsonx.string(t, "$.Description").alias("description"), F.to_json(_sub(t, "$.Parameters")).alias("parameters")).alias("function")))


def redacted(raw: Column) -> Column:
    """The digest that stands for a raw text; a missing text raises."""
    return F.when(raw.isNotNull(), F.sha2(raw, 256)).otherwise(F.raise_error(F.lit("raw text missing")))


def wire(v: Column, arguments_as_text: bool) -> Column:
    """One message (variant) as JSON text for a chat endpoint; call arguments as a string or as an object, ids only where the endpoint has them."""
    quoted = lambda c: F.to_json(c.cast("variant"))
    call = lambda c: F.concat(F.lit('{"function":{"arguments":'), quoted(F.to_json(_sub(c, "$.arguments"))) if arguments_as_text else F.to_json(_sub(c, "$.arguments")), F.lit(',"name":'), quoted(jsonx.string(c, "$.name")), F.lit("}"), F.concat(F.lit(',"id":'), quoted(jsonx.string(c, "$.id")), F.lit(',"type":"function"')) if arguments_as_text else F.lit(""), F.lit("}"))
    role = jsonx.string(v, "$.role")
    made = items(v, "$.toolCalls")
    head = F.concat(F.lit('{"role":'), quoted(role), F.lit(',"content":'), F.when(made.isNotNull(), F.lit('""')).otherwise(quoted(content_text(v))))
    named = F.concat(F.lit(',"tool_call_id":'), quoted(jsonx.string(v, "$.toolCallId"))) if arguments_as_text else F.concat(F.lit(',"tool_name":'), quoted(jsonx.string(v, "$.name")))
    return F.concat(head, F.when(made.isNotNull(), F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform(made, call), ","), F.lit("]"))).when(role == "tool", named).otherwise(""), F.lit("}"))


def endpoint_turn(message: Column, number: Column) -> Column:
    """An endpoint's message (JSON text) as a turn: all its calls, or its content; arguments that are no JSON object stay text."""
    quoted = lambda c: F.to_json(c.cast("variant"))
    v = jsonx.variant(message)
    made = items(v, "$.tool_calls")

    def call(c: Column, i: Column) -> Column:
        text = jsonx.string(c, "$.function.arguments")
        parsed = F.when(text.isNotNull(), F.coalesce(F.when(jsonx.kind(jsonx.variant(text)) == "OBJECT", F.to_json(jsonx.variant(text))), quoted(text))).otherwise(F.to_json(_sub(c, "$.function.arguments")))
        name = F.coalesce(jsonx.string(c, "$.id"), F.concat(F.lit("model-call-"), number.cast("string"), F.when(i > 0, F.concat(F.lit("-"), i.cast("string"))).otherwise("")))
        return F.concat(F.lit('{"id":'), quoted(name), F.lit(',"name":'), quoted(F.coalesce(jsonx.string(c, "$.function.name"), F.lit(""))), F.lit(',"arguments":'), F.coalesce(parsed, F.lit("{}")), F.lit("}"))

    calls = F.concat(F.lit('{"role":"assistant","toolCalls":['), F.array_join(F.transform(made, call), ","), F.lit("]}"))
    plain = F.concat(F.lit('{"role":"assistant","content":'), quoted(F.coalesce(jsonx.string(v, "$.content"), F.lit(""))), F.lit("}"))
    return F.when(F.size(made) > 0, calls).otherwise(plain)


#: A thought before the answer, then one call with its parameters in tags.
_THOUGHT = r"(?s)\A(?:<think>)?.*?</think>\s*"
_CALL = r"(?s)\A.*?<tool_call>\s*<function=([^>\n]+)>\s*(.*?)</function>\s*</tool_call>\s*\z"
_PARAMETER = r"(?s)<parameter=([^>\n]+)>\s*(.*?)\s*</parameter>"


def tagged_turn(raw: Column, number: Column) -> Column:
    """A model's raw text as a turn (JSON text): one well-formed call with distinct parameters, else plain content.

    A parameter's value is read as JSON where it is JSON, else as text.
    """
    text = F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("<|im_end|>"), F.lit("")), r"(?U)\A\s+|\s+\z", ""), _THOUGHT, "")
    name, body = F.trim(F.regexp_extract(text, _CALL, 1)), F.regexp_extract(text, _CALL, 2)
    keys, values = F.regexp_extract_all(body, F.lit(_PARAMETER), F.lit(1)), F.regexp_extract_all(body, F.lit(_PARAMETER), F.lit(2))
    between = F.trim(F.regexp_replace(body, _PARAMETER + r"|\s+", ""))
    well = F.regexp_like(text, F.lit(_CALL)) & (between == "") & (F.size(keys) > 0) & (F.size(F.array_distinct(keys)) == F.size(keys))
    quoted = lambda c: F.to_json(c.cast("variant"))
    pairs = F.zip_with(keys, values, lambda k, v: F.concat(quoted(k), F.lit(":"), F.coalesce(F.to_json(F.try_parse_json(v)), quoted(v))))
    call = F.concat(F.lit('{"role":"assistant","toolCalls":[{"id":"model-call-'), number.cast("string"), F.lit('","name":'), quoted(name), F.lit(',"arguments":{'), F.array_join(pairs, ","), F.lit("}}]}"))
    plain = F.concat(F.lit('{"role":"assistant","content":'), quoted(text), F.lit("}"))
    return F.when(well, call).otherwise(plain)
