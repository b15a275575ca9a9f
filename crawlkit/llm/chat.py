"""Event-sourced chat logs: fold the events of each message, then render and mask.

Events have ``conv_id, seq, msg, kind, role, text``. Within a conversation they apply in
the order of ``seq``; ties go by role, then text. ``msg`` names the message an event
belongs to. Kinds:

- ``message``: a whole message; a second one under the same ``msg`` is a message of its own
- ``delta``: text appended to the newest message of ``msg`` (it opens one if there is none)
- ``edit``: the text so far is replaced
- ``regenerate``: the text so far is thrown away; deltas that follow fill it again

Messages stand in the order of their first event. NULL texts are empty, NULL roles are
empty, a NULL or unknown kind is ``message``; NULL ``conv_id`` or ``msg`` are groups of
their own; NULL ``seq`` sorts first.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles
every ``<|`` gets a backslash in between (``<\\|`` becomes ``<\\\\|`` and so on), so control
strings occur only where the template puts them, and reading back takes one away. In
roles ``%`` and line ends are percent-coded too, since a line end closes the role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MESSAGE = "struct<seq:bigint,role:string,parts:array<string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _header(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role(header: Column) -> Column:
    return F.replace(F.replace(unescape(header), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _step(done: Column, event: Column) -> Column:
    """One event applied to the messages made so far under one ``msg``."""
    last = F.element_at(done, -1)
    opens = (F.size(done) == 0) | ~event.kind.isin("delta", "edit", "regenerate")
    text = F.array(event.text)
    parts = (
        F.when(opens | (event.kind == "edit"), text)
        .when(event.kind == "regenerate", F.array().cast("array<string>"))
        .otherwise(F.concat(last.parts, text))
    )
    message = F.struct(
        F.when(opens, event.seq).otherwise(last.seq).alias("seq"),
        F.when(opens, event.role).otherwise(F.coalesce(last.role, event.role)).alias("role"),
        parts.alias("parts"),
    ).cast(MESSAGE)
    return F.when(opens, F.concat(done, F.array(message))).otherwise(
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(message))
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, seq, role, text``."""
    seq = F.col("seq").cast("bigint")
    kind = F.coalesce("kind", F.lit("message"))
    event = F.struct(seq.alias("seq"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"))
    groups = events.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(event)).alias("events"))
    folded = groups.select(
        "conv_id", F.explode(F.aggregate("events", F.array().cast(f"array<{MESSAGE}>"), _step)).alias("m")
    )
    return folded.select(
        "conv_id", F.col("m.seq").alias("seq"), F.col("m.role").alias("role"), F.array_join("m.parts", "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns``.

    ``turns`` has a struct per message: where its (escaped) text starts and ends in
    ``formatted``, in code points, and whether it counts for the loss (assistant texts).
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), _header(role), F.lit("\n"))
    body = escape(F.col("text"))
    turns = messages.select(
        "conv_id", "seq", "role", "text", head.alias("head"), body.alias("body"), (role == "assistant").alias("loss")
    ).withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n")))
    ordered = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # A conversation becomes one string in one row, so its rows do meet in one task here.
    placed = turns.withColumns(
        {
            "no": F.row_number().over(ordered),
            "at": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"),
        }
    )
    turn = F.struct("no", "piece", F.struct(
        F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"), "loss").alias("turn"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    return whole.select(
        "conv_id", F.array_join("all.piece", "").alias("formatted"), F.col("all.turn").alias("turns")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """``messages`` (role, text, loss) added, taken from ``formatted`` and its mask alone.

    A text is what stands between ``start`` and ``end`` of its turn. Each is cut from its
    own turn's stretch, which begins where the turn before ended, so that the time stays
    linear in long conversations.
    """
    chunks = F.split("formatted", r"<\|im_end\|>\n", -1)
    own = F.slice(chunks, 1, F.size(chunks) - 1)

    def message(chunk: Column, no: Column) -> Column:
        turn = F.get("turns", no)
        begins = F.coalesce(F.get("turns", no - 1)["end"] + len(END) + 1, F.lit(0))
        header = F.regexp_extract(chunk, r"\A<\|im_start\|>([^\n]*)\n", 1)
        body = F.substr(chunk, (turn.start - begins + 1).cast("int"), (turn.end - turn.start).cast("int"))
        return F.struct(_role(header).alias("role"), unescape(body).alias("text"), turn.loss.alias("loss"))

    return rendered.withColumn("messages", F.transform(own, message))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold, then render: the operator as a whole."""
    return render(fold(events))
