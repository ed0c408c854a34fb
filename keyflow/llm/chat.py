"""Chat formatting by a compiled template, and reading formatted text back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm.template import compile_template

#: What marks turns in the production template; inside texts they are broken by a backslash.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text|guard }} [/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text|guard }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role|guard }}[TEXT]{{ m.text|guard }}[/ROLE]{% endif %}"
    "{% endfor %}"
)
_CONTROL = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROLS))
_BROKEN = re.compile(r"\\(\\?)")


def guard(text: str) -> str:
    """text with backslashes doubled and a backslash after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unguard(text: str) -> str:
    return _BROKEN.sub(r"\1", text)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text in the production format. Raises ValueError where it isn't one."""
    at = 0

    def upto(mark: str) -> str:
        nonlocal at
        end = text.find(mark, at)
        if end < 0:
            raise ValueError(f"{mark} is missing")
        got = text[at:end]
        at = end + len(mark)
        return unguard(got)

    while at < len(text):
        for opens, closes, role in (("[INST] ", " [/INST]", "user"), ("<s>", "</s>", "assistant"), ("[ROLE]", "[/ROLE]", None)):
            if text.startswith(opens, at):
                at += len(opens)
                yield (role, upto(closes)) if role else (upto("[TEXT]"), upto(closes))
                break
        else:
            raise ValueError("a turn must begin here")


def format_chats(turns: DataFrame, template: str = TEMPLATE, filters: dict | None = None) -> DataFrame:
    """conv_id, text, learn (array of start, end in code points: what is under generation markers), one row for each conv_id.

    Rows are taken by turn, then role and text where turns tie; repeated rows are turns of their own. Null role or text:
    empty. Null turn: first. Null conv_id: a conversation like any other. Adjoining learnt pieces have a span each.
    Rows are sorted by the shuffle and rendered as they come, so only a conversation's output is held. Other columns
    aren't looked at. No rows: no rows.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    filters = {"guard": guard} | (filters or {})

    def chats(batches):
        render = compile_template(template, filters)
        stream = ((c, {"role": r, "text": t}) for batch in batches for c, r, t in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "role", "text")], strict=True))
        held: list = next(stream, None)

        def of(conv):
            nonlocal held
            while held is not None and held[0] == conv:
                now, held = held[1], next(stream, None)
                yield now

        out, size = [], 0
        while held is not None:
            conv, parts, learn, at = held[0], [], [], 0
            messages = of(conv)
            for piece, learnt in render({"messages": messages}):
                if learnt:
                    learn.append({"start": at, "end": at + len(piece)})
                parts.append(piece)
                at += len(piece)
            for _ in messages:  # what the template left out
                pass
            out.append((conv, "".join(parts), learn))
            size += at
            if size > 2 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return rows.mapInArrow(chats, "conv_id long, text string, learn array<struct<start: long, end: long>>")


def _batch(rows: list) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), span), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "text", "learn"])


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What formatted chats hold, read back from their text and spans."""
    import hashlib

    def read(batches):
        for batch in batches:
            out = []
            for conv, text, learn in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "learn")], strict=True):
                turns, n = hashlib.sha256(), 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                learnt = "".join(unguard(text[x["start"] : x["end"]]) for x in learn)
                out.append((conv, n, turns.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
