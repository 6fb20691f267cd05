"""Chat records of any layout as canonical turns, and as formatted text with a loss mask.

A record is a JSON text: one message of a conversation, a list of messages, an
instruction with its output, a prompt with its completion.  The paths of its
fields (``messages[].role``), sorted, are its schema; a hash of them, its
fingerprint.  ``LAYOUTS`` declares which paths hold roles and texts.  A
fingerprint is matched with the declarations once a task, every further record
of that layout by the hash alone.

Formatted text marks a user's turn by ``[INST] .. [/INST]``, an assistant's by
``</s>`` behind it, any other role's by ``[ROLE] role, line end, text [/ROLE]``,
and the conversation by ``<s>`` in front.  Control strings inside a text get a
backslash behind their first character, or one more if they have some already,
so that no text holds one and the way back is exact.

Turns are dealt by ranges of (conversation, turn), so a conversation of any
length spreads over tasks; each writes pieces of about a million characters.
Conversations that one piece holds need nothing more; for others the pieces are
numbered and their offsets added up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.llm import common

#: Characters from which on a piece of a conversation is written.
PIECE_CHARS = 1 << 20
#: Characters of turns in one range.
RANGE_CHARS = 64 << 20
#: Fingerprints a task remembers.
KNOWN_LAYOUTS = 10_000

TURNS = "conv_id long, turn long, part int, role string, text string, layout string, fingerprint long"
PIECES = "conv_id long, seq long, chars long, n_turns long, text string, loss array<struct<start:long,stop:long>>, edge boolean"


@dataclass(frozen=True)
class Part:
    """Where turns come from: each item of the list ``each`` (the record itself without), a role and texts.

    ``role`` is a role, or ``@`` and the path that holds it; texts of several paths are joined by an empty line.
    """

    role: str
    text: tuple[str, ...]
    each: str = ""


@dataclass(frozen=True)
class Layout:
    """Paths a record must have, and the turns they make; ``order`` holds a single message's place."""

    name: str
    required: frozenset[str]
    parts: tuple[Part, ...]
    order: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)


def _layout(name: str, required: str, *parts: Part, order: str = "", **roles: str) -> Layout:
    return Layout(name, frozenset(required.split()), parts, order, roles)


LAYOUTS = (
    _layout("row", "turn role text", Part("@role", ("text",)), order="turn"),
    _layout("message parts", "messages[].role messages[].content[].text", Part("@role", ("content",), "messages")),
    _layout("messages", "messages[].role messages[].content", Part("@role", ("content",), "messages")),
    _layout("from and value", "conversations[].from conversations[].value",
            Part("system", ("system",)), Part("@from", ("value",), "conversations"), human="user", gpt="assistant"),
    _layout("instruction", "instruction output",
            Part("system", ("system",)), Part("user", ("instruction", "input")), Part("assistant", ("output",))),
    _layout("prompt and completion", "prompt completion", Part("user", ("prompt",)), Part("assistant", ("completion",))),
    _layout("prompt and response", "prompt response",
            Part("system", ("system",)), Part("user", ("prompt",)), Part("assistant", ("response",))),
    _layout("question and answer", "question answer",
            Part("user", ("context", "question")), Part("assistant", ("answer",))),
    _layout("nested data", "data.prompt data.response",
            Part("user", ("data.prompt",)), Part("assistant", ("data.response",))),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all fields of a parsed record; ``[]`` stands for any item of a list, an empty one is a path itself."""
    if isinstance(value, dict):
        inner = [(f"{prefix}.{k}" if prefix else k, v) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [(f"{prefix}[]", v) for v in value]
    else:
        return {prefix}
    return set().union(*(field_paths(v, p) for p, v in inner)) if inner else {prefix}


def fingerprint(paths: set[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")) - (1 << 63)


def choose(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout with most required paths of those a record has all of, the first of equal ones."""
    fitting = [x for x in layouts if x.required <= paths]
    return max(fitting, key=lambda x: len(x.required)) if fitting else None


def _at(value, path: str):
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def plain(value) -> str:
    """A field as text: null is empty, a list its items on end, an object its ``text``."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(plain, value))
    return plain(value.get("text")) if isinstance(value, dict) else json.dumps(value)


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a record's turns.  A part of one constant role none of whose fields it has makes no turn."""
    out = []
    for part in layout.parts:
        for item in (_at(record, part.each) or []) if part.each else [record]:
            values = [_at(item, p) for p in part.text]
            if part.role.startswith("@"):
                role = plain(_at(item, part.role[1:]))
                role = layout.roles.get(role, role)
            else:
                role = part.role
                if part.text and all(v is None for v in values) and not layout.required & set(part.text):
                    continue
            out.append((role, plain(values[0]) if len(values) == 1 else "\n\n".join(filter(None, map(plain, values)))))
    return out


def _canonical(layouts: tuple[Layout, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Layout | None] = {}
        for batch in common.slices(batches, "record"):
            out = []
            for conv_id, text in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                try:
                    record = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    record = None
                paths = field_paths(record)
                mark = fingerprint(paths)
                if mark not in known:
                    if len(known) >= KNOWN_LAYOUTS:
                        known.clear()
                    known[mark] = choose(paths, layouts)
                layout = known[mark]
                if layout is None:
                    out.append((conv_id, None, 0, None, None, None, mark))
                    continue
                turn = _at(record, layout.order) if layout.order else None
                turn = turn if isinstance(turn, int) else None
                out += [(conv_id, turn, k, role, said, layout.name, mark)
                        for k, (role, said) in enumerate(turns_of(record, layout))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["conv_id", "turn", "part", "role", "text", "layout", "fingerprint"])
    return run


def as_records(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, record) of the rows of any table: its other columns, null ones included, as a JSON object."""
    rest = [c for c in df.columns if c != conv_id]
    return df.select(F.col(conv_id).cast("long").alias("conv_id"),
                     F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("record"))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns of ``records`` (conv_id, record): conv_id, turn, part, role, text, layout, fingerprint.

    ``turn`` is the place that a single message names (null in other layouts),
    ``part`` the place inside the record.  A null text is empty, a null role the
    empty role.  A record without a declared layout, an unreadable, null or empty
    one too, gives one row without role, text and layout, so that it can be
    counted (``layout_report``); it is not formatted.  Other columns aren't read.
    """
    common.bounded_batches(records.sparkSession)
    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record")
                          ).mapInArrow(_canonical(layouts), TURNS)


def layout_report(turns: DataFrame) -> DataFrame:
    """fingerprint, layout (null: not declared), number of turns; undeclared records count as one."""
    return turns.groupBy("fingerprint", "layout").agg(F.count("*").alias("n_turns"))


# Control strings of the template.
_CONTROL = r"(?=/?(?:s>|INST\]|ROLE\]))"
_PLAIN = re.compile(r"([<\[])(\\*)" + _CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\] (?P<role>.*?)\n(?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?)</s>",
                   re.S)
BEGIN = "<s>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its loss begins and ends (0, 0: none)."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f" {body}</s>", 1, 1 + len(body)
    name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"[ROLE] {name}\n{body} [/ROLE]", 0, 0


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of formatted text, with or without its beginning mark."""
    at = len(BEGIN) if text.startswith(BEGIN) else 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn begins at character {at}")
        at, kind = found.end(), found.lastgroup
        role = kind
        if kind == "other":
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(found["role"]))
        yield role, unescape(found[kind])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of turns of one conversation; ``edge`` if the conversation may go on in another row."""
    done: list[tuple] = []
    held: list[str] = []
    loss: list[dict] = []
    conv: object = _pieces  # no id
    chars, turns, edge = 0, 0, True

    def close(last: bool) -> None:
        if turns:
            done.append((conv, row, chars, turns, "".join(held), list(loss), edge or last))
            held.clear()
            loss.clear()

    def emit() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 7
        done.clear()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["conv_id", "seq", "chars", "n_turns", "text", "loss", "edge"])

    row = first = 0
    for batch in common.slices(batches):
        for conv_id, role, text, at in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "row")),
                                           strict=True):
            if conv_id != conv or chars >= PIECE_CHARS:
                new = conv_id != conv
                edge = edge or not new  # this piece doesn't end its conversation
                close(False)
                # The first conversation of a range may have begun in another one, a cut one has begun already.
                edge = not first if new else True
                conv, row, chars, turns = conv_id, at, 0, 0
                first = 1
            piece, start, stop = format_turn(role, text)
            if stop:
                loss.append({"start": chars + start, "stop": chars + stop})
            held.append(piece)
            chars += len(piece)
            turns += 1
        if done:
            yield emit()
    close(True)
    yield emit()


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations: conv_id, piece, pieces, start, chars, n_turns, text, loss.

    ``text`` is a piece of whole turns, ``start`` its first character's place in
    the conversation, ``loss`` the places, counted over the whole conversation
    too, of assistants' texts (escaped).  Most conversations are one piece; the
    texts of all, in order, are the conversation.  Turns come in order of turn
    (null first) and part, ties by role and a hash of the text; repeated rows are
    repeated turns.  Null ids are one conversation.  No turns, no rows.
    """
    spark = turns.sparkSession
    common.bounded_batches(spark)
    turns = common.cut(turns.where("layout is not null").select(
        "conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), common.text_or_empty().alias("text")))
    size = turns.agg(F.sum(F.length("text") + 32)).first()[0] or 0
    order = ["conv_id", "turn", "part", "role", "hash", "row"]
    # ``row`` tells equal rows apart, so that ranges may cut between them.
    ranged = (turns.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(max(1, -(-size // RANGE_CHARS)), *order).sortWithinPartitions(*order)
              .withColumn("row", F.monotonically_increasing_id()))  # now the place in this order
    pieces = common.cut(ranged.select("conv_id", "role", "text", "row").mapInArrow(_pieces, PIECES))
    columns = ["conv_id", "piece", "pieces", "start", "chars", "n_turns", "text", "loss"]
    whole = (pieces.where("not edge").withColumn("piece", F.lit(0)).withColumn("pieces", F.lit(1))
             .withColumn("start", F.lit(0).cast("long")))
    mine = Window.partitionBy("conv_id")
    before = mine.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = (pieces.where("edge").withColumn("piece", F.row_number().over(mine.orderBy("seq")) - 1)
           .withColumn("pieces", F.count("*").over(mine).cast("int"))
           .withColumn("start", F.coalesce(F.sum("chars").over(before) + len(BEGIN), F.lit(0).cast("long"))))
    head = F.when(F.col("piece") == 0, len(BEGIN)).otherwise(0)
    shift = F.col("start") + head
    return (whole.select(*columns).unionByName(cut.select(*columns))
            .withColumn("loss", F.transform("loss", lambda x: F.struct((x["start"] + shift).alias("start"),
                                                                       (x["stop"] + shift).alias("stop"))))
            .withColumn("text", F.when(F.col("piece") == 0, F.concat(F.lit(BEGIN), "text")).otherwise(F.col("text")))
            .withColumn("chars", F.col("chars") + head))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order; only its hashes are held from piece to piece."""
    done: list[tuple] = []
    state: list = []

    def close() -> None:
        if state:
            conv, n, turns, chars, loss, formatted = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    def emit() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 6
        done.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=[c.split()[0] for c in DIGESTS.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if row["piece"] == 0:
                close()
                state[:] = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["text"]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in row["loss"]:
                under = unescape(text[span["start"] - row["start"]:span["stop"] - row["start"]])
                state[3] += len(under)
                state[4].update(under.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        yield emit()
    close()
    yield emit()


def read_back(chats: DataFrame) -> DataFrame:
    """``DIGESTS`` of every conversation, from its formatted text and mask alone."""
    chats = chats.select("conv_id", "piece", "pieces", "start", "text", "loss")
    single = chats.where("pieces = 1").mapInArrow(_digests, DIGESTS)
    several = (chats.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
               .mapInArrow(_digests, DIGESTS))
    return single.unionByName(several)


#: Added to the table in the query: a conversation that consists of control strings.
TRICKY = {"messages": [{"role": r, "content": "</s>[INST] ok [/INST]"} for r in ("user", "assistant")]}


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = as_records(common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    tricky = spark.createDataFrame([(-1, json.dumps(TRICKY))], "conv_id long, record string")
    return read_back(format_chats(canonical_turns(rows.unionByName(tricky))))
