"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation becomes one string by a template, and a deterministic parser reads it back. The grammar:
a conversation is a row of turns; a turn is start, role, says, text, end; roles and texts hold no control
string. Reading takes one escape sign away behind each opener (the first character of a control string).

Texts are tried at three levels until what was read equals what was meant:
0. as they are: right for a turn that is read back alike by itself;
1. an escape sign behind each opener that starts a control string or already has a sign behind it;
2. a sign behind every opener of all texts and roles of the conversation, for what only arises where
   texts and marks meet.
All levels are undone by the same reading, so the reader needs to know none. The loss mask is a list of
byte spans of the assistant's texts.

A conversation is one row, as its string is; conversations of any number lie evenly over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicledger.llm.common import materialise

#: Control strings of common public chat templates.
CONTROLS = (
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)


def _quoted(text: str) -> str:
    """A pattern for the text alone, alike for Java and RE2."""
    return re.sub(r"([^A-Za-z0-9\n ])", r"\\\1", text)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the escape sign, and the control strings that texts must not hold. The marks' own control strings are among them."""

    start: str = "<|start_header_id|>"
    says: str = "<|end_header_id|>\n\n"
    end: str = "<|eot_id|>"
    sign: str = "~"
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        if len(self.sign) != 1 or any(self.sign in c or len(c) < 2 for c in self.controls):
            raise ValueError("the escape sign is one character that no control string holds, and control strings have two characters or more")
        if any(not any(c in mark for c in self.controls) for mark in (self.start, self.says, self.end)):
            raise ValueError("each mark must hold a control string")

    @property
    def opener(self) -> str:
        return "[" + "".join(_quoted(c) for c in sorted({c[0] for c in self.controls})) + "]"

    @property
    def forbidden(self) -> str:
        """Any control string, told by its opener first."""
        rests = {o: [_quoted(c[1:]) for c in self.controls if c[0] == o] for o in sorted({c[0] for c in self.controls})}
        return "|".join(f"{_quoted(o)}(?:{'|'.join(r)})" for o, r in rests.items())

    @property
    def to_escape(self) -> str:
        """An opener, and what makes it one to escape."""
        return f"({self.opener})({_quoted(self.sign)}|" + "|".join(_quoted(c[1:]) for c in self.controls) + ")"

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, self.to_escape, f"$1\\{self.sign}$2")

    def escape_all(self, c: Column) -> Column:
        return F.regexp_replace(c, f"({self.opener})", f"$1\\{self.sign}")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, f"({self.opener}){_quoted(self.sign)}", "$1")

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.start), role, F.lit(self.says), text, F.lit(self.end))

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), role, F.lit(self.says))

    def _turn(self, piece: Column) -> Column:
        """What stands behind a start mark as a turn; null if it isn't one."""
        says, end = F.lit(self.says), F.lit(self.end)

        def turn(role: Column, text: Column) -> Column:
            clean = ~F.rlike(role, F.lit(self.forbidden)) & ~F.rlike(text, F.lit(self.forbidden))
            return F.when((F.concat(role, says, text, end) == piece) & clean, F.struct(self.unescape(role).alias("role"), self.unescape(text).alias("text")))

        rest = lambda role: F.substring(piece, F.char_length(role) + len(self.says) + 1, F.char_length(piece))
        return _let(F.substring_index(piece, self.says, 1), lambda role: _let(F.substring_index(rest(role), self.end, 1), lambda text: turn(role, text)))

    def parse(self, formatted: Column) -> Column:
        """The turns of a formatted conversation, as array<struct<role, text>>; none of an empty string; null if it isn't one."""
        def turns(pieces: Column) -> Column:
            found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), self._turn)
            return F.when(F.element_at(pieces, 1) == "", _let(found, lambda x: F.when(F.forall(x, lambda t: t.isNotNull()), x)))

        return _let(F.split(formatted, _quoted(self.start), -1), turns)


def format_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant", template: Template = Template()) -> DataFrame:
    """One row per conversation: id_col, formatted, loss_spans array<struct<start, length>> (bytes of UTF-8), level (the highest that was needed).

    Rows lie by turn; equal turns by role and text, nulls first; repeated rows stay. Null roles and texts are
    empty, null ids are one conversation. Other columns are ignored, whatever their names. An empty table
    gives no rows. A text of any length stays whole.
    """
    t = template
    rows = conversations.select(F.col(id_col).alias(id_col), F.col(turn_col).alias("__turn"), F.coalesce(F.col(role_col), F.lit("")).alias("__role"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    alone = t.parse(t.render(F.col("__role"), F.col("__text")))
    fits = F.coalesce(alone == F.array(F.struct(F.col("__role").alias("role"), F.col("__text").alias("text"))), F.lit(False))
    rows = rows.withColumn("__level", F.when(fits, 0).otherwise(1))
    own = lambda c: F.when(F.col("__level") == 0, F.col(c)).otherwise(t.escape(F.col(c)))
    # each turn in both forms that it can have, and where it begins in either
    rows = rows.select(id_col, "__turn", "__role", "__text", "__level", *(F.struct(r.alias("role"), x.alias("text")).alias(n) for n, r, x in (
        ("__weak", own("__role"), own("__text")), ("__strong", t.escape_all(F.col("__role")), t.escape_all(F.col("__text"))))))
    before = Window.partitionBy(id_col).orderBy("__turn", "__role", "__text").rowsBetween(Window.unboundedPreceding, -1)
    size = lambda n: F.octet_length(t.render(F.col(n).role, F.col(n).text)).cast("long")
    begin = lambda n: F.coalesce(F.sum(size(n)).over(before), F.lit(0).cast("long"))
    rows = rows.withColumn("__w", begin("__weak")).withColumn("__s", begin("__strong"))
    turns = F.sort_array(F.collect_list(F.struct("__turn", "__role", "__text", "__w", "__s", "__weak", "__strong")))
    whole = rows.groupBy(id_col).agg(turns.alias("__turns"), F.max("__level").alias("__level"))

    meant = F.transform("__turns", lambda x: F.struct(x["__role"].alias("role"), x["__text"].alias("text")))
    text = lambda n: F.concat_ws("", F.transform("__turns", lambda x: t.render(x[n].role, x[n].text)))
    # a generator between two projections keeps what it makes from being worked out again wherever it is used
    whole = whole.select("*", F.inline(F.array(F.struct(text("__weak").alias("__text"), meant.alias("__meant")))))
    whole = whole.select("*", F.explode(F.array(F.coalesce(t.parse(F.col("__text")) == F.col("__meant"), F.lit(False)))).alias("__same"))
    learnt = F.filter("__turns", lambda x: x["__role"] == learn)
    spans = lambda n, at: F.transform(learnt, lambda x: F.struct((x[at] + F.octet_length(t.head(x[n].role))).alias("start"), F.octet_length(x[n].text).cast("long").alias("length")))
    out = whole.select(
        id_col, "__same", F.when(F.col("__same"), F.col("__text")).otherwise(text("__strong")).alias("formatted"),
        F.when(F.col("__same"), spans("__weak", "__w")).otherwise(spans("__strong", "__s")).alias("loss_spans"),
        F.when(F.col("__same"), F.col("__level")).otherwise(2).alias("level"), "__meant")
    again = F.coalesce(t.parse(F.col("formatted")) == F.col("__meant"), F.lit(False))
    held = F.when(F.col("__same"), F.col("formatted")).when(again, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not read back as it was: its marks can't be told from texts")))
    return out.select(id_col, held.alias("formatted"), "loss_spans", "level")


def read_conversations(formatted: DataFrame, id_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """Read back from format_conversations: id_col, turns array<struct<role, text>>, loss_text (what the spans cover, unescaped, in order, nothing between)."""
    covered = F.transform(F.array(F.col("formatted").cast("binary")), lambda b: F.concat_ws("", F.transform(
        "loss_spans", lambda s: template.unescape(F.substring(b, (s.start + 1).cast("int"), s.length.cast("int")).cast("string")))))
    return formatted.select(id_col, F.inline(F.array(F.struct(template.parse(F.col("formatted")).alias("turns"), F.element_at(covered, 1).alias("loss_text")))))


def digests(conversations: DataFrame, id_col: str = "conv_id", template: Template = Template()) -> DataFrame:
    """Formats the conversations, writes them, and says of what is read back: id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, level."""
    written = materialise(format_conversations(conversations, id_col, template=template), "chats")
    both = written.select(F.col(id_col).alias("__conv"), F.char_length("formatted").cast("long").alias("formatted_chars"), "level", "formatted", "loss_spans")
    read = read_conversations(both.withColumn("__id", F.struct("__conv", "formatted_chars", "level")), "__id", template)
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))))
    return read.select(
        F.col("__id.__conv").alias(id_col), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.col("__id.formatted_chars"), F.col("__id.level"))


def oracle(template: Template = Template()) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = f"regexp_replace(text, {q(template.to_escape)}, {q(chr(92) + '1' + template.sign + chr(92) + '2')}, 'g')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (SELECT *, {escaped} AS safe, regexp_matches(text, {q(template.forbidden)}) OR regexp_matches(text, {q(template.opener + _quoted(template.sign))}) AS odd FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + length(role) + {sum(map(len, (template.start, template.says, template.end)))})::BIGINT AS formatted_chars,
  max(CASE WHEN odd THEN 1 ELSE 0 END)::INTEGER AS level
FROM said GROUP BY conv_id
"""
