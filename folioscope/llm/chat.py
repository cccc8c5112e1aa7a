"""Chat formatting from event logs, as DataFrame functions.

A log holds events of conversations: a ``message`` opens a message, a ``delta`` adds to
its end, an ``edit`` puts a new text in its place, and a ``regenerate`` does so and
drops all messages that stood after it. The fold needs no loop: within a conversation's
log the last event that sets a message's text is found by a window, what follows it is
joined in order, and a message is dropped if an earlier message is regenerated after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Template:
    """Marks around turns, and control strings that texts must not contain unescaped.

    A control string inside a text gets a backslash after its first character, one more
    if it has some already; taking one away again restores the text.
    """

    open: str = "<s>"
    middle: str = "<r>"
    close: str = "</s>"
    control: tuple[str, ...] = ("<s>", "<r>", "</s>", "[INST]", "[/INST]", "<unk>")

    def _groups(self) -> dict[str, list[str]]:
        heads = "".join(sorted({c[0] for c in self.control}))
        for c in self.control:
            if any(h in c[1:] for h in heads) or "\\" in c:
                raise ValueError(f"control string {c!r} holds the first character of another or a backslash")
        by_head: dict[str, list[str]] = {}
        for c in self.control:
            by_head.setdefault(c[0], []).append(re.escape(c[1:]))
        return by_head

    def escape(self, text: Column) -> Column:
        for head, tails in self._groups().items():
            text = F.regexp_replace(text, F.lit(rf"({re.escape(head)})(\\*)({'|'.join(tails)})"), F.lit(r"$1\\$2$3"))
        return text

    def unescape(self, text: Column) -> Column:
        for head, tails in self._groups().items():
            text = F.regexp_replace(text, F.lit(rf"({re.escape(head)})\\(\\*)({'|'.join(tails)})"), F.lit("$1$2$3"))
        return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages of logs: conv_id, pos (from 1), role, text.

    Columns of events: conv_id, seq, kind, target (seq of the message it is about; null:
    the last one opened), role, text. Null texts and roles count as empty, a null kind as
    ``message``. Events of equal seq come in the order of kind, role and text; equal
    messages of equal seq stay apart. Events about messages that were never opened, and
    those with no conversation, are left out. Other columns are ignored.
    """
    log = events.select(
        "conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "target",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull()).repartition("conv_id")
    opens = F.col("kind") == "message"
    order = [F.col("seq"), F.when(opens, 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3), F.col("role"), F.col("text")]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    log = log.withColumn("n", F.row_number().over(conv))
    by_n = Window.partitionBy("conv_id").orderBy("n")
    log = log.withColumn("key", F.when(opens, F.col("seq")).otherwise(F.coalesce("target", F.last(F.when(opens, F.col("seq")), ignorenulls=True).over(by_n))))
    same = Window.partitionBy("conv_id", "key", "kind").orderBy("n")
    log = log.withColumn("twin", F.when(opens, F.row_number().over(same)).otherwise(1))
    message = Window.partitionBy("conv_id", "key", "twin")
    sets = F.col("kind").isin("message", "edit", "regenerate")
    log = log.withColumns({
        "opened": F.min(F.when(opens, F.col("n"))).over(message),
        "last_set": F.max(F.when(sets, F.col("n"))).over(message),
        "remade": F.max(F.when(F.col("kind") == "regenerate", F.col("n"))).over(message),
    }).where(F.col("opened").isNotNull() & (F.col("n") >= F.col("opened")))
    messages = log.groupBy("conv_id", "key", "twin").agg(
        F.first("opened").alias("opened"), F.max("remade").alias("remade"),
        F.max(F.when(opens, F.col("role"))).alias("role"),
        F.sort_array(F.collect_list(F.when((F.col("n") >= F.col("last_set")) & (sets | (F.col("kind") == "delta")), F.struct("n", "text")))).alias("parts"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("opened").rowsBetween(Window.unboundedPreceding, -1)
    kept = messages.withColumn("cut", F.max("remade").over(earlier)).where(F.col("cut").isNull() | (F.col("cut") < F.col("opened")))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("opened"))
    return kept.select("conv_id", pos.alias("pos"), "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, template: Template = Template(), learn: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans.

    A loss span is an escaped text of the role that is learned, marks left out: its start
    and length in code points of ``formatted``, the turn it lies in, and its start there.
    A conversation becomes one value, so it has to fit in one row; conversations are dealt
    over all tasks. Messages of equal pos come in the order of role and text, repeated
    ones as often as they are there; null roles and texts count as empty. Other columns
    are ignored, whatever their names; no messages give no rows.
    """
    turns = messages.select("conv_id", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.middle))
    turns = turns.withColumns({"head": head, "body": template.escape(F.col("text")), "learned": F.col("role") == learn})
    whole = F.length("head") + F.length("body") + len(template.close)
    order = Window.partitionBy("conv_id").orderBy("pos", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumns({"turn": F.row_number().over(order) - 1, "end": F.sum(whole).over(upto)})
    start = (F.col("end") - len(template.close) - F.length("body")).cast("int").alias("start")
    span = F.when(F.col("learned"), F.struct(start, F.length("body").alias("length"), "turn", F.length("head").alias("at")))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(template.close)).alias("whole")))), lambda t: t["whole"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )


def parse(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads conversations back: adds turns, an array of (role, text), and learned, the texts under the loss mask.

    The text is cut into turns once, and a span is read from its turn, so the work grows
    with the length of a conversation. Columns of the input that are named turns or
    learned are replaced, all others kept; repeated rows come back as often as they are
    there. A null text gives nulls, an empty one no turns.
    """
    pieces = F.split(F.col("formatted"), re.escape(template.close))
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    role = lambda p: F.substring_index(F.substring(p, len(template.open) + 1, 2**30), template.middle, 1)
    turns = lambda all_: F.transform(all_, lambda p: F.struct(
        template.unescape(role(p)).alias("role"),
        template.unescape(F.substring(p, F.length(role(p)) + len(template.open) + len(template.middle) + 1, F.lit(2**30))).alias("text"),
    ))
    learned = lambda all_: F.transform("loss_spans", lambda s: template.unescape(F.substring(F.get(all_, s["turn"]), s["at"] + 1, s["length"])))
    # inside the outer transform the pieces are a value; a plain reference would be cut again for each span
    read = F.transform(F.array(pieces), lambda all_: F.struct(turns(all_).alias("turns"), learned(all_).alias("learned")))
    read = formatted.withColumn("_read", F.element_at(read, 1))
    return read.withColumns({"turns": F.col("_read.turns"), "learned": F.col("_read.learned")}).drop("_read")
