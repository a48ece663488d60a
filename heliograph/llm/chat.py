"""Operator 9: chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log holds events of conversations: ``message`` starts a message, ``delta`` appends to one, ``edit`` replaces its text
and ``regenerate`` starts its text anew. Events are grouped by message first, so that a long conversation is folded by
many tasks, and the finished messages of a conversation are then put in order and rendered. A rendered conversation is
one row, and so is the largest thing that a task has to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that mark turns in chat templates; a text must never bring one in.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]")
_ANY = r"(<\|im_start\|>|<\|im_end\|>|<</?SYS>>|</?s>|\[/?INST\])"
OPEN, CLOSE = "<|im_start|>", "\n<|im_end|>\n"


def escaped(text: Column) -> Column:
    """One more backslash before each control string; what stood there before stays."""
    return F.regexp_replace(text, _ANY, r"\\$1")


def unescaped(text: Column) -> Column:
    """The inverse of `escaped`."""
    return F.regexp_replace(text, r"\\" + _ANY, "$1")


def _line(role: Column) -> Column:
    """A role as one line: each backslash is followed by s, for itself, or by n, for a newline."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _unlined(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def streamed(rows: DataFrame) -> DataFrame:
    """The log of ``rows(conv_id, turn, role, text)`` as a chat front end would have written it.

    A text of the assistant streams in as three deltas, is regenerated, and streams in again as two; any other text is
    begun, and then edited. Folding gives the rows back. Null texts are empty; each row is a message of its own, repeated
    or not.
    """
    t = F.coalesce("text", F.lit(""))

    def part(k: int, n: int) -> Column:
        begin = lambda i: F.floor(F.length(t) * i / n).cast("int")
        return F.substring(t, begin(k) + 1, begin(k + 1) - begin(k))

    def events(*of: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), x.alias("text")) for i, (kind, x) in enumerate(of)])

    none = F.lit("")
    talk = events(("message", none), ("delta", part(0, 3)), ("delta", part(1, 3)), ("delta", part(2, 3)), ("regenerate", none), ("delta", part(0, 2)), ("delta", part(1, 2)))
    log = F.when(F.col("role") == "assistant", talk).otherwise(events(("message", part(0, 2)), ("edit", t)))
    named = rows.withColumn("message", F.monotonically_increasing_id())
    return named.select("conv_id", "message", "turn", "role", F.inline(log))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of ``events(conv_id, message, turn, seq, kind, role, text)``: (conv_id, turn, nth, role, text).

    ``message`` names a message within its conversation; ``turn`` and ``role`` are those of its ``message`` event. Changes
    apply in the order of seq, then kind and text, whatever the order of rows. Several ``message`` events of one name are
    all kept, in the order of turn, role and text, and changes go to the first. Changes to a message that isn't there
    and events of unknown kinds are left out. Null texts and roles are empty; a null conv_id, name, turn or seq is a value
    like any other and comes first. Other columns are left aside; no events give no rows.
    """
    e = events.select(
        "conv_id", "message",
        F.struct(
            (F.col("kind") != "message").alias("change"), F.when(F.col("kind") == "message", F.col("turn")).alias("turn"),
            F.when(F.col("kind") == "message", F.coalesce("role", F.lit(""))).alias("role"), "seq", "kind", F.coalesce("text", F.lit("")).alias("text"),
        ).alias("e"),
    ).where("e.kind in ('message', 'delta', 'edit', 'regenerate')")
    grouped = e.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("e")).alias("es"))
    # A message's text is what came after its last edit or regeneration, with that or the message itself before it.
    last = "array_max(transform(es, (x, i) -> if(x.kind in ('edit', 'regenerate'), i, 0)))"
    changed = f"if({last} > 0, slice(es, {last} + 1, size(es)), concat(slice(es, 1, 1), filter(es, x -> x.change)))"
    final = F.expr(f"""
        transform(filter(es, x -> not x.change), (m, i) -> named_struct('turn', m.turn, 'nth', i, 'role', m.role, 'text',
            if(i > 0, m.text, array_join(transform({changed}, x -> x.text), ''))))""")
    return grouped.select("conv_id", F.inline(final))


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """Conversations of ``messages(conv_id, turn, nth, role, text)``: (conv_id, n_turns, segments).

    ``segments`` are (text, loss); their texts in a row are the formatted conversation, and those with ``loss`` are what
    a model is to learn: the escaped texts of the role ``learned``, without the marks around them.
    """
    m = messages.select("conv_id", F.struct("turn", "nth", _line(F.col("role")).alias("role"), escaped(F.col("text")).alias("text")).alias("m"))
    turns = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))

    def segments(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(OPEN), x["role"], F.lit("\n")), F.lit(False)),
            part(x["text"], x["role"] == learned),
            part(F.lit(CLOSE), F.lit(False)),
        )

    return turns.select("conv_id", F.size("ms").cast("long").alias("n_turns"), F.flatten(F.transform("ms", segments)).alias("segments"))


def formatted(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def parse(text: Column) -> Column:
    """Turns (role, text) of a formatted conversation.

    In an escaped text a backslash stands before each control string, so a closing mark after a newline is a mark.
    """
    pieces = F.split(text, r"\n<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        end = F.instr(x, "\n")
        return F.struct(
            _unlined(F.substr(x, F.lit(len(OPEN) + 1), end - F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(x, end + F.lit(1))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_back(rendered: DataFrame) -> DataFrame:
    """What the output says, turn by turn: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    text = rendered.select("conv_id", formatted().alias("f"), "segments")
    learned = F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescaped(x["text"]))
    read = text.select("conv_id", F.length("f").cast("long").alias("formatted_chars"), parse(F.col("f")).alias("turns"), F.array_join(learned, "").alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )
