"""Chat formatting from event logs, with DataFrame functions only."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events: a whole message, a streamed piece of one, a new text for one, and a new
#: start of one, after which the turns that came later are void.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


@dataclass(frozen=True)
class Template:
    """Marks around a turn: ``open`` role ``middle`` text ``close``.

    Inside roles and texts a backslash is doubled, and every mark in them gets a backslash
    after its first bracket, so that no text can hold a mark and each comes back as it was.
    Marks are of the form <...> or [...], without backslashes.
    """

    open: str = "<s>[INST]"
    middle: str = "[/INST]"
    close: str = "</s>"
    names: tuple[str, ...] = ("s>", "/s>", "INST]", "/INST]")

    def escape(self, text):
        bodies = "|".join(self.names)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])({bodies.replace(']', chr(92) + ']')})", r"$1\\$2")

    def unescape(self, text):
        bodies = "|".join(self.names)
        plain = F.regexp_replace(text, rf"([<\[])\\({bodies.replace(']', chr(92) + ']')})", "$1$2")
        return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the final messages of an event log.

    ``events`` has conv_id, seq, turn, role, kind and text. By ``seq``, a message or edit sets
    the text of its turn, a delta adds to it, and a regeneration empties it (its text, if any,
    starts the new one) and voids the messages of later turns that were logged before it. The
    role is the last one given. Equal seqs are taken in the order of kind and text, and an event that is
    repeated as a whole counts once. Null texts
    are empty; unknown kinds count as whole messages; a null conv_id or turn is a value like
    others.

    A text is what stands from the last event on that sets it, so a message is built from its
    last pieces at once, and never grown piece by piece.
    """
    order = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    rows = events.select("conv_id", "turn", "role", order.alias("event"))
    turn = Window.partitionBy("conv_id", "turn")
    sets = F.when(F.col("event.kind") != DELTA, F.col("event"))
    restart = F.when(F.col("event.kind") == REGENERATE, F.col("event.seq"))
    rows = rows.withColumn("set", F.max(sets).over(turn)).withColumn("restart", F.max(restart).over(turn))
    live = rows.withColumn("piece", F.when(F.col("set").isNull() | (F.col("event") >= F.col("set")), F.col("event")))
    texts = F.transform(F.array_sort(F.collect_set("piece")), lambda e: e["text"])
    messages = live.groupBy("conv_id", "turn").agg(
        F.max_by("role", "event").alias("role"), F.array_join(texts, "").alias("text"),
        F.max("event.seq").alias("last"), F.max("restart").alias("restart"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    void = F.max("restart").over(before) > F.col("last")
    return messages.withColumn("void", F.coalesce(void, F.lit(False))).where("NOT void").select("conv_id", "turn", "role", "text")


def render(messages: DataFrame, template: Template = Template(), learned="assistant") -> DataFrame:
    """conv_id, formatted and loss_spans (start from 0 and length in code points of the texts
    with the role ``learned``) of each conversation of ``messages``.

    Turns stand in order; equal turns in the order of role and text. Null roles and texts are
    empty. A conversation is one text, so its turns come together in one task.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(F.lit(template.open), template.escape(empty("role")), F.lit(template.middle))
    body = template.escape(empty("text"))
    rows = messages.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("plain"),
                                               head.alias("head"), body.alias("body")).alias("t"))
    size = F.length("t.head") + F.length("t.body") + len(template.close)
    end = F.sum(size).over(Window.partitionBy("conv_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    start = (end - F.length("t.body") - len(template.close)).cast("long")
    span = F.when(F.col("t.role") == learned, F.struct(start.alias("start"), F.length("t.body").cast("long").alias("length")))
    placed = rows.withColumn("span", span).withColumn("piece", F.concat("t.head", "t.body", F.lit(template.close)))
    joined = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t.turn", "t.role", "t.plain", "piece"))).alias("p"),
                                           F.array_sort(F.collect_list("span")).alias("loss_spans"))
    return joined.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), "loss_spans")


def parse(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with ``turns`` (role, text), read back from the rendered text, and
    ``loss_text``, all that lies in ``loss_spans``, unescaped."""
    whole = F.split("formatted", template.close, -1)
    pieces = F.slice(whole, 1, F.size(whole) - 1)
    role = lambda p: F.substring_index(p, template.middle, 1)
    turns = F.transform(pieces, lambda p: F.struct(
        template.unescape(F.substr(role(p), F.lit(len(template.open) + 1))).alias("role"),
        template.unescape(F.substr(p, F.length(role(p)) + len(template.middle) + 1)).alias("text")))
    masked = F.transform("loss_spans", lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.withColumn("turns", turns).withColumn("loss_text", template.unescape(F.array_join(masked, "")))


def format_chats(events: DataFrame, template: Template = Template()) -> DataFrame:
    """The conversations of an event log, folded into messages and rendered."""
    return render(fold(events), template)


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as logged messages: each row is one, also where turns
    are equal or null (these come first)."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    return conversations.select("conv_id", number.alias("seq"), number.alias("turn"), "role", F.lit(MESSAGE).alias("kind"), "text")


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(role || chr(1) || text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'),
         '\[(/?INST\])', '[\\\1', 'g')) - 1 + length('<s>[INST][/INST]</s>') AS n FROM given)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
