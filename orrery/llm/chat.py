"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages (role, content) to a string. ``format_chat`` renders growing
prefixes of a conversation and compares consecutive outputs: where an output begins with the one before it, the
rest is the new turn's span, and a probe in place of the turn's content tells where in the span the content lies.
A turn whose output does not continue the one before marks a template that rewrites history (``rewrites``); the
spans of such a conversation are then located in the final output by probing each turn there.

``control_template`` marks turns with control strings, and puts an escape character into any control string, or
escape character, inside a text; ``unescape`` undoes that exactly.

A conversation is the rows of one ``conv_id`` (null is one too) by turn, then role and text, nulls first; null text
and null role count as empty. An empty table gives no conversations. One conversation is one output row, so it
is held whole by the task that formats it, and no task holds more than its own. As each prefix is rendered anew, time grows
with the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's control strings and its escape character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[AS]")
ESCAPE = "\\"
PROBE = "\U000f1e5a\U000f1e5b\U000f1e5a"

Message = dict[str, str]
Template = Callable[[list[Message]], str]

_special = re.compile("|".join(re.escape(c) for c in (ESCAPE, *CONTROLS)))


def escape(text: str) -> str:
    return _special.sub(lambda m: ESCAPE + m[0] if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.?)", r"\1", text, flags=re.S)


def control_template(messages: list[Message]) -> str:
    out = []
    for m in messages:
        if m["role"] == "user":
            out.append(f"<s>[INST] {m['content']} [/INST]")
        elif m["role"] == "assistant":
            out.append(f"[AS] {m['content']}</s>")
        else:
            out.append(f"[ROLE]{escape(m['role'])}[AS] {m['content']}[/ROLE]")
    return "".join(out)


def content_at(template: Template, messages: list[Message], k: int, full: str) -> tuple[int, int] | None:
    """Where the content of message k lies in ``full``, the rendering of ``messages``; None if the template alters or drops it."""
    probe = PROBE
    while any(probe in m["content"] or probe in m["role"] for m in messages):
        probe += PROBE[0]
    seen = template([*messages[:k], {**messages[k], "content": probe}, *messages[k + 1 :]])
    start = seen.find(probe)
    end = start + len(messages[k]["content"])
    return (start, end) if start >= 0 and full[:start] == seen[:start] and full[end:] == seen[start + len(probe) :] and full[start:end] == messages[k]["content"] else None


def render(template: Template, messages: list[Message]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], list[bool]]:
    """The final output; by turn its span, its content's span ((-1, -1) if there is none), and whether it rewrote what came before."""
    before, spans, contents, rewrites = template([]), [], [], []
    for k in range(len(messages)):
        prefix = messages[: k + 1]
        now = template(prefix)
        rewrites.append(not now.startswith(before))
        spans.append((len(before), len(now)))
        # the probe below only re-renders this prefix: what follows cannot matter unless history is rewritten
        contents.append(content_at(template, prefix, k, now) or (-1, -1))
        before = now
    if any(rewrites):
        contents = [content_at(template, messages, k, before) or (-1, -1) for k in range(len(messages))]
        starts = [a for a, _ in contents]
        spans = [(a, b) if a >= 0 else (-1, -1) for a, b in contents]
        assert len(starts) == len(messages)
    return before, spans, contents, rewrites


FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()),
    T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("content_start", T.LongType()), T.StructField("content_end", T.LongType()), T.StructField("rewrites", T.BooleanType())]))),
    T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def format_chat(conversations: DataFrame, template: Template = control_template, escaping: Callable[[str], str] = escape) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans): spans in code points of ``formatted``; the loss mask is the assistants' content."""
    id_type = conversations.schema["conv_id"].dataType
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column("m").to_pylist():
                messages = [{"role": x["role"], "content": escaping(x["text"])} for x in m]
                text, spans, contents, rewrites = render(template, messages)
                turns = [{"role": x["role"], "start": s[0], "end": s[1], "content_start": c[0], "content_end": c[1], "rewrites": r} for x, s, c, r in zip(messages, spans, contents, rewrites)]
                loss = [{"start": c[0], "end": c[1]} for x, c in zip(messages, contents) if x["role"] == "assistant" and c[0] >= 0]
                rows.append({"formatted": text, "turns": turns, "loss_spans": loss})
            columns = [pa.array([r[n] for r in rows], t) for n, t in zip(("formatted", "turns", "loss_spans"), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "formatted", "turns", "loss_spans"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in FORMATTED.fields]
    return whole.mapInArrow(run, T.StructType([T.StructField("conv_id", id_type), *FORMATTED.fields]))


_turn = re.compile(r"<s>\[INST\] (.*?) \[/INST\]|\[AS\] (.*?)</s>|\[ROLE\](.*?)\[AS\] (.*?)\[/ROLE\]", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from what ``control_template`` gave: unescaped control strings can only be marks."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        user, assistant, role, other = m.groups()
        out.append(("user", unescape(user)) if user is not None else ("assistant", unescape(assistant)) if assistant is not None else (unescape(role), unescape(other)))
        at = m.end()
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns, read from the formatted text and its loss mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(text)
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text))
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, pa.string() if k in (1, 3) else pa.int64()) for k, c in enumerate(cols)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    names = T.StructType([T.StructField("conv_id", formatted.schema["conv_id"].dataType), *[T.StructField(n, T.StringType() if n.endswith("256") else T.LongType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]])
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, names)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of two turns that hold control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(format_chat(rows.unionByName(hard)))


_said = "'</s>[INST] ok [/INST]'"
OP4_SQL = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', {_said} UNION ALL SELECT -1, 1, 'assistant', {_said}),
x AS (SELECT *, regexp_replace(text, '(\\\\)|(<)(s>|/s>)|(\\[)(INST\\]|/INST\\]|ROLE\\]|/ROLE\\]|AS\\])', '\\1\\2\\4\\\\\\3\\5', 'g') AS e FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(e) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 9 ELSE 18 + length(role) END) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
