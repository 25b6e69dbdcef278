"""Chat formatting from event logs.

A log holds events of conversations: a message opens a message at its turn, a delta appends to the
message that is open there, an edit replaces what it holds so far, and a regeneration drops what it
holds so that later deltas fill it anew. fold() makes the final messages, render() one segment of
formatted text for each; a conversation's text is its segments in order. A log is partitioned by
conversation and, so that a long one spreads over tasks, by turn within it: events act on their own turn alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import prepare

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string"
START, END = "<|im_start|>", "<|im_end|>\n"
KINDS = ("message", "delta", "edit", "regenerate")


def as_events(conversations: DataFrame, pieces: int = 4) -> DataFrame:
    """The log that a session would leave of conversations (conv_id, turn, role, text); other columns are ignored.

    A row is a message that opens empty and whose text streams in as so many deltas. By a hash of the row, a third
    of them stream a draft first and are regenerated, and a third end with another text that an edit sets right.
    Events of equal turns follow one another by row, in the order of role and text. Null texts and roles stay null.
    """
    turn, text = F.col("turn").cast("long"), F.col("text").cast("string")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    way = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(3))
    step = F.greatest(F.ceil(F.length("text") / pieces), F.lit(1)).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    none = F.lit(None).cast("string")
    deltas = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: event("delta", F.substring(F.col("text"), i * step + 1, step)))
    draft = F.array(event("delta", F.reverse("text")), event("delta", F.lit(" ...")), event("regenerate", none))
    late = F.array(event("delta", F.lit(" and so on")), event("edit", F.col("text")))
    nothing = F.array().cast("array<struct<kind:string,text:string>>")
    log = F.concat(F.array(event("message", none)), F.when(way == 1, draft).otherwise(nothing), deltas, F.when(way == 2, late).otherwise(nothing))
    rows = own.withColumn("nth", nth).select("conv_id", "turn", "role", "nth", F.posexplode(log).alias("i", "event"))
    # a row has six events at most besides its deltas
    seq = F.shiftleft(F.coalesce("turn", F.lit(-1)), 24) + F.col("nth") * max(16, pieces + 6) + F.col("i")
    return rows.select("conv_id", seq.alias("seq"), "event.kind", "turn", "role", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, text: the final messages.

    Events of a turn count in the order of seq (nulls first), then kind as in KINDS, role, text;
    repeated events each count. Each message event of a turn opens a message of its own: part numbers
    them from 1, and is 0 for events before the first. Null texts and roles are empty; a message's
    role is that of the event that opens it. Unknown kinds are an error. An empty log gives no rows.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    kind = F.when(kind > 0, kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    e = events.select("conv_id", "turn", "seq", kind.cast("int").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["seq", "kind", "role", "text"]
    w = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = e.withColumn("part", F.count(F.when(F.col("kind") == 1, 1)).over(w)).withColumn("place", F.row_number().over(w))
    # what counts is the last event of a part that isn't a delta, and the deltas after it; the rest goes before rows are gathered
    part = Window.partitionBy("conv_id", "turn", "part")
    opened = parts.withColumn("role", F.first("role").over(part.orderBy("place")))
    reset = F.max(F.when(F.col("kind") != 2, 1)).over(part.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1))
    live = opened.withColumn("reset", reset).where("reset is null")
    grouped = live.groupBy("conv_id", "turn", "part").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("log"))
    return grouped.select("conv_id", "turn", "part", "role", F.array_join(F.transform("log", lambda x: x["text"]), "").alias("text"))


def escape_text(c: Column) -> Column:
    """Puts one more backslash into each <|, <\\|, <\\\\| and so on, so that no <| is left."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_text(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), s)


def render(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """conv_id, turn, part, segment, loss_from, loss_to.

    loss_from and loss_to bound the learned role's text within the segment, in code points; both are
    null for other roles.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape_text(F.col("text"))
    learned = F.col("role") == learned_role
    made = messages.select("conv_id", "turn", "part", head.alias("head"), body.alias("body"), learned.alias("learned"))
    return made.select("conv_id", "turn", "part", F.concat("head", "body", F.lit(END)).alias("segment"), F.when(F.col("learned"), F.length("head")).alias("loss_from"), F.when(F.col("learned"), F.length("head") + F.length("body")).alias("loss_to"))


def format_conversations(events: DataFrame) -> DataFrame:
    """The log's final messages as segments of formatted text; see fold and render."""
    return render(fold(events))


def assemble(rendered: DataFrame) -> DataFrame:
    """conv_id and its whole formatted text, for conversations that fit a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "part", "segment")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("formatted"))


_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text. Raises ValueError where it isn't such text."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _SEGMENT.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape_text(m[2])))
        at = m.end()
    return out


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, from its formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests run over a conversation's segments in order as they stream by, so no conversation is ever
    held whole; a digest of a sequence needs its bytes in order, hence in one task.
    """
    prepare(rendered.sparkSession)

    def run(batches):
        now: tuple | None = None
        rows: list[tuple] = []

        def begin(conv):
            return [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        state = None
        for batch in batches:
            for conv, segment, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if now != (conv,):
                    if state:
                        rows.append((*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                    now, state = (conv,), begin(conv)
                for role, text in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    learned = unescape_text(segment[a:b])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
            if rows:
                yield _batch(rows)
                rows = []
        if state:
            yield _batch([(*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])])

    ordered = rendered.select("conv_id", "turn", "part", "segment", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
