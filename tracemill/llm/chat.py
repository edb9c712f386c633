r"""Chat formatting: records of unknown layout to canonical turns, to a marked text with a loss mask, and back.

A record is a JSON text. Its layout is known by its fingerprint, the hash of
its nested field paths at every depth, without the types of the leaves.
Declarative mappings, one for each fingerprint, say where turns are; the
fingerprint of each row picks its mapping, so rows of many layouts may lie in
one column. Everything is Spark SQL expressions: no Python runs on executors.

The template is ``<|im_start|>role\ntext<|im_end|>\n`` for each turn. In texts
and roles every ``<`` followed by back-slashes and a ``|`` gets one back-slash
more, so no control string can occur inside, and taking one away gives the
text back. A role's line feeds and back-slashes are escaped besides.

Nulls: a null text or role is empty; a null turn number sorts first. Equal
turn numbers sort by role, then text; repeated rows stay. A record that no
mapping fits, or that is no JSON, has null turns; one larger than Spark's limit
for a variant raises an error. Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
#: JSON texts shorter than this always fit into a variant.
VARIANT_BYTES = 1 << 23


@dataclass(frozen=True)
class Mapping:
    """Turns of one layout, known by a ``sample`` record of it. ``fields`` lists (role, path of a text) that come first, in order;
    ``items`` is the path of a list of messages, with the paths of an item's role and text. ``roles`` renames roles."""

    name: str
    sample: str
    fields: tuple[tuple[str, str], ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

#: Layouts known from public instruction and chat data sets, and a nested one.
MAPPINGS = (
    Mapping("messages", '{"messages":[{"role":"","content":""}]}', items="messages"),
    Mapping("messages_text", '{"messages":[{"role":"","text":""}]}', items="messages", text="text"),
    Mapping("conversations", '{"conversations":[{"from":"","value":""}]}', items="conversations", role="from", text="value", roles=SPEAKERS),
    Mapping("system_conversations", '{"system":"","conversations":[{"from":"","value":""}]}', (("system", "system"),), "conversations", "from", "value", SPEAKERS),
    Mapping("dialog", '{"dialog":{"system":"","turns":[{"by":{"role":""},"say":{"text":""}}]}}', (("system", "dialog.system"),), "dialog.turns", "by.role", "say.text"),
    Mapping("prompt_response", '{"prompt":"","response":""}', (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", '{"prompt":"","completion":""}', (("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", '{"instruction":"","output":""}', (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", '{"instruction":"","input":"","output":""}', (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", '{"question":"","answer":""}', (("user", "question"), ("assistant", "answer"))),
    Mapping("system_question_response", '{"system_prompt":"","question":"","response":""}', (("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
)

#: A leaf's type in the text of a variant's schema.
LEAF_TYPE = r"(?<=: |<|^)(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]*\))?(?=[,>]|$)"


def layout_of(record: Column) -> Column:
    """The nested field paths of a variant as one text: names in order, nesting by brackets, no types of leaves."""
    return F.regexp_replace(F.schema_of_variant(record), LEAF_TYPE, "")


def fingerprint(record: Column) -> Column:
    """The hash of a variant's nested field paths; the order of fields in the JSON text does not count."""
    return F.sha2(layout_of(record), 256)


def _mapped_role(role: Column, m: Mapping) -> Column:
    out = role
    for old, new in m.roles:
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns_by(m: Mapping, record: Column) -> Column:
    """The turns that one mapping reads from a variant record."""
    read = [(role, F.try_variant_get(record, f"$.{path}", "string")) for role, path in m.fields]
    turns = F.array_compact(F.array(*(F.when(text.isNotNull(), _turn(F.lit(role), text)) for role, text in read))) if read else F.array().cast(TURNS)
    if m.items:
        items = F.try_variant_get(record, f"$.{m.items}", "array<variant>")
        turns = F.concat(turns, F.transform(items, lambda x: _turn(_mapped_role(F.try_variant_get(x, f"$.{m.role}", "string"), m), F.try_variant_get(x, f"$.{m.text}", "string"))))
    return turns


def parsed(json: Column) -> Column:
    """JSON as a variant, null for what is no JSON; a text that only its size keeps from being one raises an error."""
    return F.when(F.octet_length(json) < VARIANT_BYTES, F.try_parse_json(json)).otherwise(F.parse_json(json))


def turns_of_json(json: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Canonical turns of JSON records: each row's fingerprint selects its mapping; null where none fits."""
    record, out = parsed(json), F.lit(None).cast(TURNS)
    prints = fingerprint(record)
    for m in mappings:
        out = F.when(prints == fingerprint(F.parse_json(F.lit(m.sample))), _turns_by(m, record)).otherwise(out)
    return out


def records_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id, record: a row a turn (conv_id, turn, role, text) gathered into JSON, in the layout that data of its shape come in.

    A user's turn with an assistant's is a prompt and its response; a system
    text before users and assistants is a nested dialog; users and assistants
    alone are named by speakers; any other conversation is a list of messages.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    m = F.col("m")
    said = lambda at: F.try_element_at(m, F.lit(at))["text"]
    roles = F.transform(m, lambda x: x["role"])
    rest = F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(1)))
    two = lambda turns: F.forall(turns, lambda x: x["role"].isin("user", "assistant"))
    pair = F.struct(said(1).alias("prompt"), said(2).alias("response"))
    turns = F.transform(rest, lambda x: F.struct(F.struct(x["role"].alias("role")).alias("by"), F.struct(x["text"].alias("text")).alias("say")))
    dialog = F.struct(F.struct(said(1).alias("system"), turns.alias("turns")).alias("dialog"))
    spoken = F.struct(F.transform(m, lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["text"].alias("value"))).alias("conversations"))
    plain = F.struct(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    json = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(pair)).when((F.size(m) > 1) & (roles[0] == "system") & two(rest), F.to_json(dialog)).when(two(m), F.to_json(spoken)).otherwise(F.to_json(plain))
    return gathered.select("conv_id", json.alias("record"))


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # cut at doubled back-slashes first, so that the second of them isn't read with an n
    parts = F.split(unescape_text(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: Column) -> Column:
    """The marked text of canonical turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape_text(t["text"]), F.lit(END + "\n"))), "")


def segments(formatted: Column) -> Column:
    """Turns of a marked text with their still escaped texts: array of (role, body)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), F.substring_index(F.substr(p, F.locate("\n", p) + 1), END, 1).alias("body")))


def parse_turns(formatted: Column) -> Column:
    """Canonical turns of a marked text."""
    return F.transform(segments(formatted), lambda s: _turn(unescape_role(s["role"]), unescape_text(s["body"])))


def loss_spans(formatted: Column, trained_role: str = "assistant") -> Column:
    """(start, length) in code points of the bodies that training counts, in the marked text."""
    step = F.aggregate(
        segments(formatted),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + len(START) + F.length(s["role"]) + 1 + F.length(s["body"]) + len(END) + 1).cast("long").alias("at"),
            F.when(unescape_role(s["role"]) == trained_role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + len(START) + F.length(s["role"]) + 1).cast("long").alias("start"), F.length(s["body"]).cast("long").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return step


def format_records(records: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of JSON records (conv_id, record) of any known layouts."""
    marked = records.select("conv_id", format_turns(turns_of_json(F.col("record"))).alias("formatted"))
    return marked.withColumn("loss_spans", loss_spans(F.col("formatted")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of a row-a-turn table."""
    return format_records(records_of_rows(rows))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: the turns, and the text under the loss mask."""
    turns = parse_turns(F.col("formatted"))
    masked = F.transform("loss_spans", lambda s: unescape_text(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), F.array_join(masked, "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
