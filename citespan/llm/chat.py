"""Chat formatting: records of any known layout become turns, and turns become one training text.

A record's *fingerprint* is the hash of its sorted nested field paths (``messages[].role``).  Layouts are
declared as data (``LAYOUTS``): which paths a layout has, and where a turn's role and text stand.  The
fingerprints of all combinations of a layout's optional paths select its mapping by lookup; fields that
no layout names (ids, sources, scores) don't enter the fingerprint.  A record whose fingerprint is no
layout's own, since it has the fields of several, gets the first layout whose needed paths it has.

A turn is rendered as ``### Role: text</turn>`` and a newline.  Control strings inside roles and texts are
escaped (see ``ESCAPES``), so the turns and the loss mask can be read back from the text alone.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Text and what stands for it; the first is the escape sign itself, so that nothing is ambiguous.
ESCAPES = (("\\", "\\\\"), ("</turn>", "\\t"), ("###", "\\h"))
_BACK = {"\\\\": "\\", "\\t": "</turn>", "\\h": "###"}
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LABELS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
ROLES = {v: k for k, v in LABELS.items()}
#: Roles under other names.
SAME_ROLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """needs and may: field paths.  Either turns come from a list (turns, role, text), or from parts:
    (role, paths whose texts are joined by blank lines), in order; a part without text gives no turn."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), ("system", "messages[].content[].type", "messages[].content[].text"), "messages", "role", "content", (("system", ("system",)),)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("system",), "conversations", "from", "value", (("system", ("system",)),)),
    Layout("dialog", ("dialog[].speaker", "dialog[].text"), (), "dialog", "speaker", "text"),
    Layout("instruction", ("instruction", "output"), ("input", "system"), parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction response", ("instruction", "response"), ("context", "system"), parts=(("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",)))),
    Layout("prompt completion", ("prompt", "completion"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt response", ("prompt", "response"), ("system",), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question answer", ("question", "answer"), ("context",), parts=(("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("nested", ("data.prompt", "data.response"), (), parts=(("user", ("data.prompt",)), ("assistant", ("data.response",)))),
)
_KNOWN_PATHS = frozenset(p for x in LAYOUTS for p in (*x.needs, *x.may))


def field_paths(value: object) -> set[str]:
    """Paths of all leaves of a JSON value; list elements are ``[]``.  Nulls and empty lists are leaves; so
    is a list of a turn's content parts, whose own paths are there too."""
    out, todo = set(), [("", value)]
    while todo:  # no recursion: records can be nested deeply
        path, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(f"{path}.{k}" if path else str(k), x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            if path.endswith(".content"):
                out.add(path)
            todo += [(f"{path}[]", x) for x in v]
        else:
            out.add(path)
    return out


def type_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """The same paths of a column type."""
    if isinstance(kind, T.StructType):
        return set().union(*(type_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields))
    return type_paths(kind.elementType, f"{prefix}[]") if isinstance(kind, T.ArrayType) else {prefix}


def fingerprint(paths: set[str]) -> str:
    """Hash of the paths that some layout names, sorted."""
    return hashlib.sha256("\n".join(sorted(paths & _KNOWN_PATHS)).encode()).hexdigest()[:16]


def _registry() -> dict[str, Layout]:
    out = {}
    for x in LAYOUTS:
        for n in range(len(x.may) + 1):
            for some in itertools.combinations(x.may, n):
                out.setdefault(fingerprint({*x.needs, *some}), x)
    return out


REGISTRY = _registry()


def layout_of(paths: set[str]) -> tuple[str, Layout | None]:
    """(fingerprint, layout) of field paths: by lookup, or else the first layout whose needs are met."""
    mark = fingerprint(paths)
    return mark, REGISTRY.get(mark) or next((x for x in LAYOUTS if x.needs and paths.issuperset(x.needs)), None)


def role_name(role: object) -> str:
    name = "" if role is None else str(role)
    return SAME_ROLE.get(name.lower(), name)


def _at(value: object, path: str) -> object:
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _plain(text: str) -> str:
    """text, with a replacement character for each half of a surrogate pair that stands alone."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if not text.isascii() else text


def _text(value: object) -> str:
    """A value as text; of a list of content parts the texts, by blank lines.  Other values are JSON, or empty
    where they are nested too deeply to be written."""
    if value is None:
        return ""
    if isinstance(value, list) and value and all(isinstance(p, str) or isinstance(p, dict) and ("text" in p or "type" in p) for p in value):
        return "\n\n".join(filter(None, (_text(p if isinstance(p, str) else p.get("text")) for p in value)))
    try:
        return _plain(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True))
    except RecursionError:  # nested more deeply than JSON can be written
        return ""


def record_turns(record: str | None) -> tuple[str, str, list[tuple[str, str]]]:
    """(fingerprint, layout, turns) of one JSON record, whatever it is.

    The layout is '' if there is none for its fields, or the record isn't a JSON object, and there are then
    no turns.  Elements of a list of turns that aren't objects (nulls, texts) are no turns.
    """
    try:
        value = json.loads(record) if record else None
    except (ValueError, RecursionError):
        value = None
    if not isinstance(value, dict):
        return "", "", []
    mark, x = layout_of(field_paths(value))
    if x is None:
        return mark, "", []
    if x.name == "rows":
        return mark, x.name, [(_plain(role_name(value.get("role"))), _text(value.get("text")))]
    turns = [(role, "\n\n".join(filter(None, (_text(_at(value, p)) for p in paths)))) for role, paths in x.parts]
    turns = [t for t in turns if t[1]]
    listed = _at(value, x.turns) if x.turns else None
    for turn in listed if isinstance(listed, list) else ():
        if isinstance(turn, dict):
            turns.append((_plain(role_name(turn.get(x.role))), _text(turn.get(x.text))))
    return mark, x.name, turns


TURNS = "fingerprint string, layout string, turns array<struct<role string, text string>>"


def turns_of_records(records: DataFrame, column: str = "record") -> DataFrame:
    """records with fingerprint, layout and turns of the JSON text in ``column``; no row is dropped.

    A null, empty or broken record has fingerprint '' and layout ''.
    """

    def run(s):
        import pandas as pd

        rows = [record_turns(r) for r in s]
        return pd.DataFrame({"fingerprint": [r[0] for r in rows], "layout": [r[1] for r in rows], "turns": [[{"role": a, "text": b} for a, b in r[2]] for r in rows]})

    import pandas as pd

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return records.withColumn("found", F.pandas_udf(run, TURNS)(F.col(column))).select(*records.columns, "found.*")


def rows_of_table(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table with a row for each turn, chosen by the schema's fingerprint.

    Other columns don't matter, whatever their names.  Raises ValueError if the table has no such layout.  Null roles and texts are empty; other roles stay
    as they are written.
    """
    paths = type_paths(df.schema)
    layout = layout_of(paths)[1]
    if layout is None or not paths.issuperset(LAYOUTS[0].needs):
        raise ValueError("the table has no row for each turn")
    return df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def escaped(text: Column) -> Column:
    for raw, mark in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def segment(role: Column, text: Column) -> Column:
    """A turn's part of the training text.  A role without a label is written as ``=role``, escaped,
    with its colons doubled."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    other = F.concat(F.lit("="), F.replace(escaped(role), F.lit(":"), F.lit("::")))
    return F.concat(F.lit(OPEN), F.coalesce(F.try_element_at(labels, role), other), F.lit(MIDDLE), escaped(text), F.lit(CLOSE))


def format_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, segment: the training text of a conversation, in the order of turns, is its
    segments one after the other.  One narrow step: long conversations stay many rows."""
    return turns.select("conv_id", "turn", segment(F.col("role"), F.col("text")).alias("segment"))


def render(turns: list[tuple[str, str]]) -> str:
    """The training text of a list of turns."""

    def esc(s: str) -> str:
        for raw, mark in ESCAPES:
            s = s.replace(raw, mark)
        return s

    return "".join(OPEN + LABELS.get(r, "=" + esc(r).replace(":", "::")) + MIDDLE + esc(t) + CLOSE for r, t in turns)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\th]", lambda m: _BACK[m.group()], text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; formatted[start:end] is the turn's escaped text, which is
    under the loss mask if the role is assistant."""
    out, at = [], 0
    while at < len(formatted):
        end = formatted.index(CLOSE, at)
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        m = re.compile(r"=((?:[^:]|::)*): |([A-Za-z]+): ").match(formatted, at + len(OPEN))
        role = ROLES[m.group(2)] if m.group(2) else unescape(m.group(1).replace("::", ":"))
        out.append((role, unescape(formatted[m.end() : end]), m.end(), end))
        at = end + len(CLOSE)
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reading:
    """One conversation's digests, taken up segment by segment."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str) -> None:
        for role, text, _, _ in parse(segment):
            self.n += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.loss_sha.update(text.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose segments come in order, one conversation after the other; holds
    one batch and one conversation's running digests, however long it is."""
    now: _Reading | None = None
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.string() if "sha" in n else pa.int64() for n in names]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        done = []
        for conv_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            if now is None or now.conv_id != conv_id:
                done += [now.row()] if now else []
                now = _Reading(conv_id)
            now.add(text.as_py())
        if done:
            yield batch(done)
    if now:
        yield batch([now.row()])


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conv_id (null is one conversation too) with what is read back from its text.

    Turns with the same number stand in the order of their segments.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment").mapInArrow(read_back, DIGESTS)


#: A conversation that holds the template's own control strings.
PLANTED = r"\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that imitates the template, formatted and read back."""
    read = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return digests(format_rows(rows_of_table(read).unionByName(more)))


_ESCAPED = r"replace(replace(replace(text, '\', '\\'), '</turn>', '\t'), '###', '\h')"
OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || {_ESCAPED} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
