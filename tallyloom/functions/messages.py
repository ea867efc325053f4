"""Expressions over the text of one chat message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, any_of, col, contains_any, group, matches, strip, sub

# Sender prefix of a relayed message, and the trailing parts cut off.
RELAY = r"\] (?:DM|PM|Group|Chat)?\s*(?:from|in)?\s*\S*:\s*([\s\S]*)"
TAILS = [
    r"\n\nConversation info[\s\S]*\z",
    r"\n\[message_id:[\s\S]*\z",
    rf"\nou_{WORD}{{32}}: [\s\S]*\z",
]
# Thinking tags, then the separators between thinking and answer.
THINKING_TAGS = [
    r"<thinking>[\s\S]*?</thinking>",
    r"<reasoning>[\s\S]*?</reasoning>",
    r"`*`*`*thinking`*`*`*",
]
THINKING_ENDS = ["---", "___", "\n\n\n答", "\n\n回答", "\n\n回复"]
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
FENCED = rf"```{WORD}*\n[\s\S]*?\n```"


def clean_message(c: Column | str) -> Column:
    """Drop control characters and trim."""
    return strip(sub(strip(F.coalesce(col(c), F.lit(""))), CONTROL))


def clean_parts(parts: Column | str) -> Column:
    """Text of an array of ``struct<type, text>`` content parts: non-empty text parts joined by a space."""
    texts = F.transform(
        F.filter(col(parts), lambda p: p["type"] == "text"),
        lambda p: strip(F.coalesce(p["text"], F.lit(""))),
    )
    return strip(sub(F.array_join(F.filter(texts, lambda t: t != ""), " "), CONTROL))


def _is_relayed(c: Column) -> Column:
    return c.startswith("System:") | c.startswith("system:")


def strip_wrapper(c: Column | str) -> Column:
    """Remove relayed-message prefixes, however often they are nested, and the trailing metadata."""
    c = col(c)
    depth = F.size(F.split(c, "[Ss]ystem:")) - 1

    def unwrap(state: Column, _: Column) -> Column:
        text, active = state["text"], state["active"]
        relayed = matches(text, RELAY)
        inner = F.when(relayed, strip(F.regexp_extract(text, RELAY, 1))).otherwise(
            strip(F.substring(text, F.instr(text, F.lit(":")) + F.lit(1), F.length(text)))
        )
        return F.struct(
            F.when(active, inner).otherwise(text).alias("text"),
            (active & relayed & _is_relayed(inner)).alias("active"),
        )

    start = F.struct(c.alias("text"), F.lit(True).alias("active"))
    unwrapped = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), start, unwrap, lambda s: s["text"])
    out = F.when(_is_relayed(c), unwrapped).otherwise(c)
    for tail in TAILS:
        out = sub(out, tail)
    return out


def is_machine_made(c: Column | str) -> Column:
    """True for messages (already trimmed) written by the client, not by a person."""
    t = col(c)
    low = F.lower(t)
    return any_of(
        [
            t == "",
            _is_relayed(t),
            t.startswith("/new"),
            t.startswith("/reset"),
            contains_any(low, ["a new session was started", "queued messages while"]),
            t.startswith("[queued messages"),
            t.startswith("[media attached"),
            t.startswith("media:"),
            t.startswith("system ["),
            contains_any(low, ["exec completed", "exec failed"]),
            low.startswith("conversation info"),
            low.startswith("message_id"),
            matches(t, r"\A\[\d{4}"),
            ~matches(t, WORD),
        ]
    )


def split_thinking(c: Column | str) -> Column:
    """``struct<thinking, answer>``: by tag, else by the first separator with text on both sides."""
    c = col(c)

    def pair(thinking: Column, answer: Column) -> Column:
        return F.struct(thinking.alias("thinking"), answer.alias("answer"))

    tries = []
    for tag in THINKING_TAGS:
        found = F.regexp_extract(c, tag, 0)
        tries.append(F.when(found != "", pair(found, strip(F.replace(c, found, F.lit(""))))))
    for end in THINKING_ENDS:
        at = F.instr(c, F.lit(end))
        before = strip(F.substring(c, F.lit(1), at - 1))
        after = strip(F.substring(c, at + F.lit(len(end)), F.length(c)))
        tries.append(F.when((at > 0) & (before != "") & (after != ""), pair(before, after)))
    return F.coalesce(*tries, pair(F.lit(""), c))


def code_chars(c: Column | str) -> Column:
    """Characters inside fenced code blocks, fences included."""
    blocks = F.regexp_extract_all(col(c), F.lit(FENCED), F.lit(0))
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b))
