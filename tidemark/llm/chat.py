r"""Chat formatting by prefix-target expansion.

A turn is written ``### role: text </turn>\n``. Inside roles and texts a backslash becomes ``\\``, ``###`` becomes
``\h\h\h`` and ``</turn>`` becomes ``\l/turn>``; in roles ``:`` becomes ``\c``. No control string is left in what is
escaped, and `unescape` undoes it exactly.

`expand` explodes conversations into one row per turn. The row of an assistant turn is a training example: its context
is all text of the conversation before ``start``, its target is the row's own text, and only ``loss_start:loss_end`` is
trainable. There contexts are given by their end; `render` writes every example out with its context in full, and `read_back` reads these examples.

Turns are dealt by conversation, sorted, and streamed in Arrow batches: memory holds the longest example and a batch of some.

Cases: null text and null role are empty; a null conv_id is a conversation of its own; turns with equal numbers are
ordered by role, then text; repeated rows are repeated turns; a conversation without an assistant has no example but
keeps its rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, bound_batches

TRAIN_ROLE = "assistant"
#: Characters of examples that are handed on at once; a longer example goes alone.
EXAMPLE_CHARS = 2_000_000
_CODES = {"\\\\": "\\", "\\h": "#", "\\l": "<", "\\c": ":"}
_TURN = re.compile(r"### (?P<role>[^:]*): (?P<text>.*?) </turn>\n", re.DOTALL)


def escape(s: str, role: bool = False) -> str:
    s = s.replace("\\", "\\\\").replace("###", "\\h\\h\\h").replace("</turn>", "\\l/turn>")
    return s.replace(":", "\\c") if role else s


def unescape(s: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _CODES[m[0]], s)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    return [(unescape(m["role"]), unescape(m["text"])) for m in _TURN.finditer(text)]


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, segment, start, example, loss_start, loss_end), sorted within a conversation.

    ``example`` numbers the assistant turns from 0 and is null elsewhere, as are the two loss bounds.
    """
    schema = f"conv_id {dict(turns.dtypes)['conv_id']}, position long, role string, segment string, start long, example long, loss_start long, loss_end long"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, start, example, first = None, 0, 0, 0, True
        for batch in batches:
            cols: list[list] = [[] for _ in out_schema]
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if first or c != conv:
                    conv, position, start, example, first = c, 0, 0, 0, False
                head = f"### {escape(role, True)}: "
                body = escape(text)
                segment = f"{head}{body} </turn>\n"
                train = role == TRAIN_ROLE
                a = start + len(head)
                for col, v in zip(cols, (c, position, role, segment, start, example if train else None, a if train else None, a + len(body) if train else None), strict=True):
                    col.append(v)
                position += 1
                start += len(segment)
                example += train
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    empty = F.lit("")
    rows = turns.select("conv_id", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), "turn")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, schema)


def render(expanded: DataFrame, rest: bool = False) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): every example with its whole context written out.

    The output of a conversation is as long as the square of its number of turns. With ``rest`` a conversation that does not end with a target
    has one more row, its whole text, without example and loss. Rows have to come as `expand` gives them; in another order the job stops.
    """
    schema = f"conv_id {dict(expanded.dtypes)['conv_id']}, example long, text string, loss_start long, loss_end long"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        conv, context, position, open_ = None, "", 0, False

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) or [()] * len(out_schema)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for c, at, segment, start, example, loss_start, loss_end in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if at == 0:
                    if rest and open_:
                        held.append((conv, None, context, None, None))
                        size += len(context)
                    conv, context, position = c, "", 0
                if c != conv or at != position or start != len(context):
                    raise ValueError(f"turn {at} of conversation {c} is not where it belongs")
                context += segment
                position += 1
                open_ = example is None
                if not open_:
                    held.append((c, example, context, loss_start, loss_end))
                    size += len(context)
                if size > EXAMPLE_CHARS:
                    yield flush()
                    size = 0
        if rest and open_:
            held.append((conv, None, context, None, None))
        yield flush()

    bound_batches(expanded.sparkSession)
    return expanded.select("conv_id", "position", "segment", "start", "example", "loss_start", "loss_end").mapInArrow(run, schema)


def read_back(expanded: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the examples that `render` writes out, their contexts and loss bounds alone.

    An example's context has to be all text of the example before it, which is parsed once, and what was said since; otherwise the job stops.
    """
    schema = f"conv_id {dict(expanded.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen, ended = None, "", True
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), len(seen)))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for c, example, text, loss_start, loss_end in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                # a row without a target is the last of its conversation
                if ended or example == 0 or c != state[0]:
                    close()
                    state, seen = [c, 0, hashlib.sha256(), 0, hashlib.sha256()], ""
                ended = example is None
                if not text.startswith(seen):
                    raise ValueError(f"example {example} of conversation {c} does not begin with the one before")
                for role, said in parse(text[len(seen) :]):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                if not ended:
                    reply = unescape(text[loss_start:loss_end])
                    state[3] += len(reply)
                    state[4].update(reply.encode())
                seen = text
            yield flush()
            done = []
        close()
        yield flush()

    return render(expanded, rest=True).mapInArrow(run, schema)
