"""Chat formatting in budgeted windows.

Prefix sums of turn tokens place every turn of a conversation; spans of turns
that fit the budget become windows. A window repeats the system turn and a
limited history before its span, and only targets of its own span bear loss.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import load_ranks
from .common import pick

START, END = "<|im_start|>", "<|im_end|>"
TARGET, SYSTEM = "assistant", "system"

#: Turn numbers that one task sums up.
SHARE = 4096
#: Windows of a conversation that one task builds, about.
BLOCK = 32

WINDOWS = (
    "conv_id {id}, block bigint, window int, formatted string, loss array<struct<start:int,end:int>>, "
    "n_repeated int, n_turns int, n_tokens bigint, over_budget boolean"
)


def escape(text: str) -> str:
    """One backslash more between < and |: no text can hold a control string."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line of the template, so line feeds are written out too."""
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def head(role: str) -> str:
    return f"{START}{escape_role(role)}\n"


TAIL = END + "\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: -len(TAIL)])))
    return turns


def windows(
    turns: DataFrame, vocabulary: str, pattern: str, budget: int = 2048, history: int = 256
) -> DataFrame:
    """One row per window: conv_id, block, window (order inside the conversation), formatted text, loss spans.

    Loss spans are code points of ``formatted`` over assistant texts of the
    window's own span; the first ``n_repeated`` of its ``n_turns`` turns are the
    system turn and history and bear no loss. A turn is never cut: one longer
    than the room left stands in a window of its own (over_budget tells).

    A null role or text is the empty one. Turns are ordered by turn (null
    first), then role and text, so ties and repeated rows have a fixed order and
    all stay. Rows with a null conv_id form one conversation. The first system
    turn of a conversation is repeated; an empty table gives no windows. Columns
    other than conv_id, turn, role and text are not read.

    A conversation is cut into blocks by its prefix sums, about BLOCK windows
    each, and a block is built by one task, so a conversation that holds a third
    of all rows is shared out. Prefix sums are taken in two steps (inside ranges
    of SHARE turn numbers, then over the ranges). The history of a block's first
    window is handed to it from the block before.
    """
    turns = pick(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    turn_kind = turns.schema["turn"].dataType.simpleString()

    def count(batches):
        import pyarrow as pa
        import tiktoken

        own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})
        frame = len(own.encode_ordinary(START)) + len(own.encode_ordinary(TAIL))
        for batch in batches:
            pairs = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())
            n = [frame + len(own.encode_ordinary(escape_role(r) + "\n")) + len(own.encode_ordinary(escape(t))) for r, t in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "tokens"])

    counted = turns.mapInArrow(count, f"conv_id {kind}, turn {turn_kind}, role string, text string, tokens bigint")
    counted = materialize(counted.withColumn("_share", F.floor(F.coalesce("turn", F.lit(0)) / SHARE)), "chat-turns")

    per_share = counted.groupBy("conv_id", "_share").agg(F.sum("tokens").alias("_sum"))
    over_shares = Window.partitionBy("conv_id").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_share.select("conv_id", "_share", F.coalesce(F.sum("_sum").over(over_shares), F.lit(0)).alias("_before"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    inside = Window.partitionBy("conv_id", "_share").orderBy(*order)
    rows = counted.withColumn("_to", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = rows["conv_id"].eqNullSafe(offsets["conv_id"]) & (rows["_share"] == offsets["_share"])
    rows = rows.join(offsets, same).select(
        rows["conv_id"], "role", "text", "tokens",
        (F.col("_before") + F.col("_to") - F.col("tokens")).alias("_from"), (F.col("_before") + F.col("_to")).alias("_upto"),
        F.lit(0).alias("_use"),
    )
    # the first system turn of a conversation goes to each of its blocks
    width = budget * BLOCK
    rows = rows.withColumn("block", F.floor(F.col("_from") / width))
    # ends of a block within reach of the next one's first turn: history there
    reach = F.floor((F.col("_upto") + history) / width)
    later = rows.where((reach > F.col("block")) & (F.col("tokens") <= history)).withColumn("block", reach).withColumn("_use", F.lit(1))
    first = rows.where(F.col("role") == SYSTEM).groupBy("conv_id").agg(F.min_by(F.struct("text", "tokens", "_from"), "_from").alias("_s"))
    spans = rows.select("conv_id", "block").distinct()
    system = spans.join(first, spans["conv_id"].eqNullSafe(first["conv_id"])).select(
        spans["conv_id"], F.lit(SYSTEM).alias("role"), "_s.text", "_s.tokens", "_s._from", F.col("_s._from").alias("_upto"),
        F.lit(2).alias("_use"), "block",
    )
    fed = rows.unionByName(later).unionByName(system)
    by = ["conv_id", "block"]
    dealt = fed.repartition(*by).sortWithinPartitions(*by, F.desc("_use"), "_from", "_upto")

    def build(batches):
        yield from _build(batches, budget, history)

    return dealt.mapInArrow(build, WINDOWS.format(id=kind))


def _build(batches, budget: int, history: int):
    """Stream the sorted turns of each block into windows; holds one window and its history."""
    import pyarrow as pa

    names = ["conv_id", "block", "window", "formatted", "loss", "n_repeated", "n_turns", "n_tokens", "over_budget"]
    out: list[tuple] = []
    key, system, recent, span, number, id_type = object(), None, [], [], 0, None

    def room_for(tokens, repeated):
        return sum(t[2] for t in repeated) + sum(t[2] for t in span) + tokens <= budget

    def repeated():
        before = [t for t in recent if system is None or t[3] != system[3]]
        return ([system] if system is not None and span[0][3] > system[3] else []) + before

    def close():
        nonlocal span, recent, number
        if not span:
            return
        lead = repeated()
        while len(lead) > (1 if system is not None and lead[:1] == [system] else 0) and sum(t[2] for t in lead + span) > budget:
            lead.pop(1 if lead[0] is system else 0)
        text, loss, at = [], [], 0
        for i, (role, body, _, _) in enumerate(lead + span):
            written, opening = escape(body), head(role)
            if i >= len(lead) and role == TARGET:
                loss.append({"start": at + len(opening), "end": at + len(opening) + len(written)})
            text.append(opening + written + TAIL)
            at += len(text[-1])
        total = sum(t[2] for t in lead + span)
        out.append((key[0], key[1], number, "".join(text), loss, len(lead), len(lead) + len(span), total, total > budget))
        recent = tail(recent + span)
        number, span = number + 1, []

    def tail(turns):
        kept, room = [], history
        for t in reversed(turns):
            if t[2] > room:
                break
            kept.insert(0, t)
            room -= t[2]
        return kept

    def flush():
        columns = list(zip(*out)) if out else [()] * len(names)
        types = [id_type, pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    held = 0
    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text", "tokens", "_from", "_use"))):
            conv, block, role, text, tokens, start, use = row
            if (conv, block) != key:
                close()
                key, system, recent, span, number = (conv, block), None, [], [], 0
            turn = (role, text, tokens, start)
            if use == 2:
                system = turn
            elif use == 1:
                recent = tail(recent + [turn])
            else:
                if span and not room_for(tokens, [system] if system is not None and span[0][3] > system[3] else []):
                    close()
                span.append(turn)
            if out:
                held += len(out[-1][3])
            if held > 1 << 25:
                yield flush()
                held = 0
    close()
    if out:
        yield flush()


def summary(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    A digest takes its bytes in order, so the windows of a conversation stream
    through one task, which keeps the running digests and no text.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def digest(batches):
        import hashlib

        import pyarrow as pa

        key, state, done, id_type = object(), None, [], None

        def finish():
            if state is not None:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, text, loss, skip in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "n_repeated"))):
                if conv != key or state is None:
                    finish()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text)[skip:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
        finish()
        if done:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], names=names)

    narrow = formatted.select("conv_id", "block", "window", "formatted", "loss", "n_repeated")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window").mapInArrow(digest, schema)
