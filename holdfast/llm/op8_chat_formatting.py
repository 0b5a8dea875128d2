"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records arrive as JSON in several layouts. The nested field paths of a record
are hashed to a fingerprint; the fingerprint selects one of the declared
``LAYOUTS``, whose expression gives the canonical turns (role, text). The
template writes a turn as ``[INST]role[/INST]text</s>``. Those three control
strings and the escape character are escaped inside roles and texts, so the
output splits back into exactly the turns. The loss mask is the list of runs of
characters of the output with a flag: assistant texts are under the mask, marks
and everything else are not.

Defined results: a null text or role is empty; a record without turns is an
empty string; a record of an undeclared layout, or not JSON, keeps a row with
layout null and no output; rows of a conversation are sorted by turn, role and
text, repeated rows all stay; a null id is an id; other columns are not read.
A conversation is one output string, so its turns come together in one row.

A VARIANT holds strings of 20 million characters and 128 MiB in all. A record
beyond that is read in two steps: its field paths from a copy whose strings are
emptied and whose equal neighbours are merged, its texts by ``from_json`` with the
layout's schema. A record whose copy is still too large to judge ends the query
with an error. A number in the place of a text keeps the spelling that it has in
the JSON text (``1.50``), whatever the size of its record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.llm.common import table

TURNS = "array<struct<role:string,text:string>>"
OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
# first character of a control string and what stands for it; the escape character comes first
ESCAPES = (("~", "~0"), (CLOSE, "~1/s>"), (OPEN, "~2INST]"), (MIDDLE, "~2/INST]"))
UNESCAPES = (("~1", "<"), ("~2", "["), ("~0", "~"))
SPEAKERS = {"human": "user", "gpt": "assistant", "system": "system"}


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for escaped, plain in UNESCAPES:
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a VARIANT, whatever the types of its values."""
    paths = F.regexp_replace(F.schema_of_variant(record), r"(?<=: |<)(?!OBJECT|ARRAY)[A-Z][A-Z_]*(\([0-9, ]+\))?(?=[,>])", "_")
    return F.substring(F.sha2(paths.cast("binary"), 256), 1, 16)


# value at a path, cast to a type; null where there is none
Get = Callable[[str, str], Column]


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


@dataclass(frozen=True)
class Layout:
    name: str
    examples: tuple[str, ...]  # records that have this layout's field paths
    fields: str  # schema of its fields
    turns: Callable[[Get], Column]


def _messages(field: str, role: str, text: str, speakers: dict[str, str] | None = None) -> Callable[[Get], Column]:
    def turns(get: Get) -> Column:
        items = get(field, f"array<struct<`{role}`:string,`{text}`:string>>")

        def turn(item: Column) -> Column:
            who = F.coalesce(item[role], F.lit(""))
            if speakers:
                names = F.create_map(*(F.lit(x) for pair in speakers.items() for x in pair))
                who = F.coalesce(F.try_element_at(names, who), who)
            return F.struct(who.alias("role"), F.coalesce(item[text], F.lit("")).alias("text"))

        return F.transform(items, turn)

    return turns


def _instruction(get: Get) -> Column:
    extra = F.coalesce(get("input", "string"), F.lit(""))
    question = F.concat(F.coalesce(get("instruction", "string"), F.lit("")), F.when(extra == "", "").otherwise(F.concat(F.lit("\n"), extra)))
    return F.array(_turn("user", question), _turn("assistant", get("output", "string")))


LAYOUTS = (
    Layout("messages", ('{"messages":[{"role":"","content":""}]}', '{"messages":[]}'),
           "messages array<struct<`role`:string,`content`:string>>", _messages("messages", "role", "content")),
    Layout("conversations", ('{"conversations":[{"from":"","value":""}]}', '{"conversations":[]}'),
           "conversations array<struct<`from`:string,`value`:string>>", _messages("conversations", "from", "value", SPEAKERS)),
    Layout("prompt", ('{"prompt":"","completion":""}',), "prompt string, completion string",
           lambda get: F.array(_turn("user", get("prompt", "string")), _turn("assistant", get("completion", "string")))),
    Layout("system_prompt", ('{"system":"","prompt":"","response":""}',), "system string, prompt string, response string", lambda get: F.array(
        _turn("system", get("system", "string")), _turn("user", get("prompt", "string")), _turn("assistant", get("response", "string")))),
    Layout("instruction", ('{"instruction":"","input":"","output":""}', '{"instruction":"","output":""}'), "instruction string, input string, output string", _instruction),
)

# records under this many bytes always fit a VARIANT
SURE = 8 << 20
CORRUPT = "__corrupt"


BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'  # of a JSON string


def spelt(record: Column) -> Column:
    """JSON text with its numbers quoted, so that they are read as they are spelt.
    What is not a JSON number stays, and stays no JSON."""
    number = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
    quoted = F.regexp_replace(record, rf'(?s)\G((?:"{BODY}"|[^"0-9-]++)*+)({number})(?=\s*+(?:[,}}\]]|\z))', '$1"$2"')
    return F.when(F.rlike(record, F.lit(r"[:\[,]\s*+[0-9-]")), quoted).otherwise(record)


def outline(record: Column) -> Column:
    """JSON text with the same field paths, its string values emptied and equal neighbours merged."""
    emptied = F.regexp_replace(record, rf'(?s)("{BODY}"\s*+:)|"{BODY}(")', "$1$2$2")
    return F.regexp_replace(emptied, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def canonical_turns(records: DataFrame, record_col: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Adds ``layout`` (name or null) and ``turns`` to records given as JSON text."""
    record = F.col("__spelt")
    parsed = records.withColumn("__spelt", spelt(F.col(record_col))).withColumn("__record", F.try_parse_json(record))
    parsed = parsed.withColumn("__large", F.col("__record").isNull() & (F.octet_length(record) >= SURE))
    parsed = parsed.withColumn("__outline", F.when(F.col("__large"), outline(record)))
    judged = F.coalesce("__record", F.try_parse_json("__outline"))
    too_large = F.raise_error(F.concat(F.lit("record too large to find its layout: bytes "), F.octet_length(record).cast("string")))
    paths = F.when(judged.isNull() & (F.octet_length("__outline") >= SURE), too_large.cast("string")).otherwise(fingerprint(judged))
    parsed = parsed.withColumn("__paths", paths)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    small: Get = lambda field, kind: F.try_variant_get(F.col("__record"), f"$.{field}", kind)
    for known in reversed(layouts):
        same = F.lit(False)
        for example in known.examples:  # constant: folded when the query is planned
            same = same | F.col("__paths").eqNullSafe(fingerprint(F.parse_json(F.lit(example))))
        whole = F.from_json(record, f"{known.fields}, {CORRUPT} string", {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": CORRUPT})
        large: Get = lambda field, kind, whole=whole: whole[field]
        fits = ~F.col("__large") | whole[CORRUPT].isNull()
        layout = F.when(same & fits, known.name).otherwise(layout)
        turns = F.when(same & ~F.col("__large"), known.turns(small).cast(TURNS)).when(same & fits, known.turns(large).cast(TURNS)).otherwise(turns)
    return parsed.withColumn("layout", layout).withColumn("turns", turns).drop("__spelt", "__record", "__large", "__outline", "__paths")


def with_template(records: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask`` (runs of characters, in order) to records with ``turns``."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    run = lambda text, loss: F.struct(F.length(text).alias("chars"), loss.alias("loss"))
    return records.withColumn("__pieces", pieces).withColumn(
        "formatted", F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "")).withColumn(
        "loss_mask", F.flatten(F.transform("__pieces", lambda p: F.array(run(p["head"], F.lit(False)), run(p["text"], p["loss"]), run(F.lit(CLOSE), F.lit(False)))))).drop("__pieces")


def format_chats(records: DataFrame, record_col: str = "record") -> DataFrame:
    """JSON records in any declared layout to ``layout``, ``turns``, ``formatted`` and ``loss_mask``."""
    return with_template(canonical_turns(records, record_col))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    items = F.split(formatted, F.lit(r"\Q" + CLOSE + r"\E"), -1)
    items = F.slice(items, F.lit(1), F.size(items) - 1)

    def turn(item: Column) -> Column:
        role = F.substring_index(F.substring(item, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)
        text = F.substring(item, F.length(role) + len(OPEN) + len(MIDDLE) + 1, F.length(item))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(items, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def step(seen: Column, run: Column) -> Column:
        text = F.when(run["loss"], F.concat(seen["text"], unescape(F.substring(formatted, seen["at"], run["chars"])))).otherwise(seen["text"])
        return F.struct((seen["at"] + run["chars"]).alias("at"), text.alias("text"))

    return F.aggregate(mask, start, step, lambda seen: seen["text"])


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn as JSON, in the layout that fits their roles."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles, text = F.transform("t", lambda x: x["role"]), lambda k: F.col("t")[k]["text"]
    layout = lambda *names: F.to_json(F.struct(*names))
    speakers = F.create_map(*(F.lit(x) for human, role in SPEAKERS.items() for x in (role, human)))
    known = F.forall(roles, lambda r: r.isin(*SPEAKERS.values()))
    return rows.select("conv_id", F.when(
        roles == F.array(F.lit("user"), F.lit("assistant")), layout(text(0).alias("prompt"), F.try_element_at("t", F.lit(2))["text"].alias("completion"))).when(
        roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
        layout(text(0).alias("system"), F.try_element_at("t", F.lit(2))["text"].alias("prompt"), F.try_element_at("t", F.lit(3))["text"].alias("response"))).when(
        known & (F.size("t") % 2 == 1),
        layout(F.transform("t", lambda x: F.struct(F.try_element_at(speakers, x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))).otherwise(
        layout(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))).alias("record"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: each conversation's turns and loss text, read back from its formatted text."""
    probe = spark.sql("""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    made = format_chats(as_records(rows)).select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), "layout")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, 6 + 7 + 4
    + length(replace(replace(replace(replace(role, '~', '~0'), '</s>', '~1/s>'), '[INST]', '~2INST]'), '[/INST]', '~2/INST]'))
    + length(replace(replace(replace(replace(text, '~', '~0'), '</s>', '~1/s>'), '[INST]', '~2INST]'), '[/INST]', '~2/INST]')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
