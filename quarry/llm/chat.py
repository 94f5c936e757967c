"""Chat formatting: turn-aligned windows under a token budget, with a mask of what a model is to learn.

Running sums of turn tokens choose spans of whole turns. Every window opens with the conversation's system turn, repeats a limited
history before its span, and only the span's own assistant texts are under the mask, so each is learnt once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import columns
from quarry.llm.tokens import byte_ids

#: The template's marks. "\u0010" escapes: control strings inside texts and roles, and the escape itself, are written so that they read back.
START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "\u0010"
#: Tokens of a window, and tokens of repeated history at most.
BUDGET, HISTORY = 1024, 256
#: Rows and code points of a batch of turns, about.
BATCH_ROWS, BATCH_CHARS = 1000, 8 << 20


def escape(c: Column) -> Column:
    """Texts without ``<|``: each such pair, and each escape sign, gets an escape sign in between or after it."""
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit("<|"), F.lit("<" + ESCAPE + "|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<" + ESCAPE + "|"), F.lit("<|")), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def escape_role(c: Column) -> Column:
    """As ``escape``, and on one line: the line end closes a role."""
    return F.replace(escape(c), F.lit("\n"), F.lit(ESCAPE + "n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(ESCAPE + "n"), F.lit("\n")))


def with_cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first four columns, and the tokens of the formatted turn, marks included. Marks begin a token of their own after a line end, so a window has just the sum of its turns."""
    for batch in batches:
        cost = [len(byte_ids(f"{START}{r}\n{t}{END}\n")) for r, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cost, pa.int64())], [*batch.schema.names[:4], "cost"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: empty) and what the turn costs."""
    rows = columns(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([*rows.schema.fields, StructField("cost", LongType())])
    return rows.select("*", escape_role(F.col("role")).alias("_role"), escape(F.col("text")).alias("_text")).mapInArrow(with_cost, schema)


def cut(budget: int, history: int):
    """Turns in order, as rows of windows: conv_id, window, seq, role, text, repeated.

    A turn that no longer fits opens a window, with the system turn and as many of the turns just before as fit beside both, at most ``history``
    tokens and half of what the system turn leaves. Nothing is held but those turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars, conv, started, kind = [], 0, None, False, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "window", "seq", "role", "text", "repeated"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, role, text, cost in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if not started or c != conv:
                    started, conv, seq, window, own, used = True, c, -1, 0, 0, 0
                    head, system, past, past_cost = None, 0, deque(), 0
                seq += 1
                rows = [(c, window, seq, role, text, False)]
                if seq == 0 and role == "system":
                    head, system, used = (role, text), cost, cost
                else:
                    if own and used + cost > budget:
                        window, own, used, again = window + 1, 0, system, []
                        limit = min(history, (budget - system) // 2, budget - system - cost)
                        for s, r, t, n in reversed(past):
                            if n > limit:
                                break
                            limit, used = limit - n, used + n
                            again.append((c, window, s, r, t, True))
                        rows = [(c, window, seq, role, text, False), *again]
                        if head:
                            rows.append((c, window, 0, *head, True))
                    own, used = own + 1, used + cost
                    past.append((seq, role, text, cost))
                    past_cost += cost
                    while past_cost > history:
                        past_cost -= past.popleft()[3]
                out += rows
                chars += sum(len(r[3]) + len(r[4]) for r in rows)
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield flush()
                    out, chars = [], 0
        if out:
            yield flush()

    return run


def piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, spans.

    spans: for each turn in ``formatted`` a struct (seq, from, length, learn, repeated) of code points of its escaped text: ``learn`` is the mask,
    set for assistant turns of the window's own span only; ``repeated`` marks the system turn after the first window and history.
    Turns are in order of (turn, role, text), a null turn first; null roles and texts are empty, a null conv_id is a conversation of its own, repeated rows are turns
    of their own. Windows hold at most ``budget`` tokens of ``byte_bpe_50k``, in which the marks are ordinary text, unless the system turn and a single other one have more. Further columns are ignored.
    """
    ordered = turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    every = ordered.mapInArrow(cut(budget, history), f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, window long, seq int, role string, text string, repeated boolean")
    part = F.struct("seq", piece(F.col("role"), F.col("text")).alias("piece"), F.length(escape_role(F.col("role"))).alias("role_length"), F.length(escape(F.col("text"))).alias("length"), ((F.col("role") == "assistant") & ~F.col("repeated")).alias("learn"), "repeated")
    grouped = every.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    folded = F.expr(
        f"""aggregate(parts, named_struct('at', 0, 'spans', cast(array() as array<struct<seq:int,from:int,length:int,learn:boolean,repeated:boolean>>)),
            (a, p) -> named_struct('at', a.at + length(p.piece), 'spans', concat(a.spans, array(named_struct(
                'seq', p.seq, 'from', a.at + {len(START)} + p.role_length + 1, 'length', p.length, 'learn', p.learn, 'repeated', p.repeated)))), a -> a.spans)"""
    )
    return grouped.select("conv_id", "window", F.array_join(F.col("parts.piece"), "").alias("formatted"), folded.alias("spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """The turns as the formatted windows hold them, each once: conv_id, seq, role, text, learn. Only ``formatted`` and the spans are used."""
    t = windows.select("conv_id", "window", "formatted", F.posexplode("spans").alias("k", "s"))
    raw = F.col("formatted").substr(F.col("s.from") + 1, F.col("s.length"))
    # Marks cannot occur inside escaped texts: the k-th start mark is the k-th turn's.
    role = F.substring_index(F.split(F.col("formatted"), r"<\|im_start\|>")[F.col("k") + 1], "\n", 1)
    return t.filter("not s.repeated").select("conv_id", "s.seq", unescape_role(role).alias("role"), unescape(raw).alias("text"), "s.learn")


def conversation_digest(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    back = read_back(windows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "learn"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda x: x["learn"]), lambda x: x["text"]), "")
    sizes = windows.groupBy(F.col("conv_id").alias("_c")).agg(F.sum(F.length("formatted")).alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = back.join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")))
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), sha(text).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars", "n_windows")
