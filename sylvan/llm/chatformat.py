r"""Chat formatting by schema fingerprints.

A record is a JSON object in any of many layouts: prompt and completion,
instruction and output, a list of messages, one turn a record. Its *schema
fingerprint* is a hash of its nested field paths (``messages[].role``); the
fingerprint selects a declarative mapping, and the mapping says which paths
hold which turns. No layout is guessed from values, none needs code of its own.

1. :func:`canonical_turns`: record -> turns (role, text), in any order of rows;
2. :func:`formatted`: turns -> one piece of text per turn, ready to be put one
   after the other, each with the span that the loss covers;
3. :func:`read_back`: pieces -> turns, from their text alone.

Only fields that some mapping names count for the fingerprint, so extra fields
change nothing. A record that is no object, or whose fingerprint no mapping
has, is not guessed at: it gives one row with ``layout`` null and no turn, with
its fingerprint and paths, so that a mapping can be added.

Template of a turn: ``### Assistant: the text</turn>\n``. In texts and roles a
backslash goes before each backslash and before the first character of
``###`` and ``</turn>`` wherever these start (in roles also before ``:``), so
the marks of the template never stand in a text and taking the backslashes away
restores it, whatever it holds. The loss covers the texts of assistant turns,
without the marks.

Turns of one conversation may lie in many records; they are put in order by
sorting inside partitions by (key, order, place in the record) and read as a
stream, so a conversation of any length costs no memory.

Defined results: null key: the turns of all such records are one conversation;
null order comes first; records equal in order follow each other by role and
text; repeated rows are repeated turns; null role or text is empty; values
that are not text are written as JSON; half a surrogate pair in a JSON escape
becomes U+FFFD; an empty list of messages gives a
conversation without turns (one piece, empty); an empty table gives no rows.
Other columns are never read. A text is held whole by one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import workers_ready

#: Layout -> the turns it holds, in order. A rule is (role, path) for one text,
#: or (path of a list, field of the role, field of the text) for many. A role
#: of the form ``=field`` is read from the record.
LAYOUTS: dict[str, list[tuple]] = {
    "turn": [("=role", "text")],
    "turn_content": [("=role", "content")],
    "messages": [("messages", "role", "content")],
    "messages_parts": [("messages", "role", "content[].text")],
    "system_messages": [("system", "system"), ("messages", "role", "content")],
    "sharegpt": [("conversations", "from", "value")],
    "system_sharegpt": [("system", "system"), ("conversations", "from", "value")],
    "prompt_completion": [("user", "prompt"), ("assistant", "completion")],
    "prompt_response": [("user", "prompt"), ("assistant", "response")],
    "system_prompt_response": [("system", "system"), ("user", "prompt"), ("assistant", "response")],
    "question_answer": [("user", "question"), ("assistant", "answer")],
    "instruction": [("user", "instruction"), ("assistant", "output")],
    "instruction_input": [("user", "instruction\n\ninput"), ("assistant", "output")],
    "system_instruction": [("system", "system"), ("user", "instruction"), ("assistant", "output")],
    "preference": [("user", "prompt"), ("assistant", "chosen")],
}
#: Fields that belong to a layout without holding a turn.
BESIDE = {"messages_parts": ["messages[].content[].type"], "preference": ["rejected"]}
#: Role field -> its names for canonical roles; any other name or field keeps what it says.
ROLES = {"from": {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}}
#: Canonical roles and their marks; any other role is written after a ``=``.
MARKS = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
LEARNED = "assistant"


# --- schema fingerprints -----------------------------------------------------

def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value that end in a plain value or an empty list or object."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(paths(v, f"{at}[]") for v in value))
    return {at}


def _rule_paths(rule: tuple) -> set[str]:
    if len(rule) == 3:
        return {f"{rule[0]}[].{f}" for f in rule[1:]}
    found = set(rule[1].split("\n\n"))
    return found | {rule[0][1:]} if rule[0].startswith("=") else found


def _layout_paths(name: str, layouts: dict) -> set[str]:
    return set().union(*map(_rule_paths, layouts[name]), BESIDE.get(name, []))


def fingerprint(found: Iterable[str]) -> str:
    """16 hex digits over the sorted paths."""
    return hashlib.blake2b("\n".join(sorted(found)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Mappings:
    """fingerprint -> layout, for a set of layouts."""

    def __init__(self, layouts: dict[str, list[tuple]] = LAYOUTS):
        self.layouts = layouts
        wanted = {name: _layout_paths(name, layouts) for name in layouts}
        self.known = set().union(*wanted.values())
        self.lists = {f"{r[0]}[]" for rules in layouts.values() for r in rules if len(r) == 3}
        self.by_print: dict[str, str] = {}
        for name, found in wanted.items():
            if (taken := self.by_print.setdefault(fingerprint(found), name)) != name:
                raise ValueError(f"layouts {taken} and {name} have the same paths")
            # a list without elements shows no field inside
            lists = [r[0] for r in layouts[name] if len(r) == 3]
            if lists:
                bare = {p for p in found if not p.startswith(tuple(f"{x}[]." for x in lists))} | {f"{x}[]" for x in lists}
                self.by_print.setdefault(fingerprint(bare), name)

    def of(self, record) -> tuple[str | None, str, set[str]]:
        """(layout or None, fingerprint, the paths it was taken over)."""
        found = paths(record) if isinstance(record, dict) else set()
        seen = {p for p in found if p in self.known or p in self.lists}
        mark = fingerprint(seen)
        return self.by_print.get(mark), mark, seen if seen else found

    def turns(self, layout: str, record: dict) -> list[tuple[str, str]]:
        out = []
        for rule in self.layouts[layout]:
            if len(rule) == 3:
                out += [(_role(m, rule[1]), _at(m, rule[2])) for m in record[rule[0]]]
            else:
                role = _role(record, rule[0][1:]) if rule[0].startswith("=") else rule[0]
                texts = [_at(record, p) for p in rule[1].split("\n\n")]
                # an optional second field (an instruction's input) that is empty adds nothing
                out.append((role, "\n\n".join([texts[0], *[t for t in texts[1:] if t]])))
        return out


_HALF = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    if value is None:
        return ""
    return _HALF.sub("\ufffd", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def _role(record: dict, field: str) -> str:
    role = _text(record.get(field))
    return ROLES.get(field, {}).get(role, role)


def _at(record: dict, path: str) -> str:
    """The text at a field, or the texts of a list of parts (``content[].text``) in a row."""
    if "[]." in path:
        many, field = path.split("[].")
        return "".join(_text(part.get(field)) for part in record[many])
    return _text(record.get(path))


# --- the template ------------------------------------------------------------

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"\\|:|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD, _TAIL = "### ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.S)


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head_of(role: str) -> str:
    return f"{_HEAD}{MARKS.get(role) or '=' + _ROLE_CONTROL.sub(r'\\\g<0>', role)}: "


_NAMES = {mark: role for role, mark in MARKS.items()}
_TURNS = re.compile(r"### (?:(?:[^\\:]|\\.)*): (?:[^\\]|\\.)*?</turn>\n", re.S)


def turns_in(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a whole formatted conversation."""
    pieces = _TURNS.findall(text)
    if sum(map(len, pieces)) != len(text):
        raise ValueError("not a formatted conversation")
    return [turn_of(p)[:2] for p in pieces]


def turn_of(piece: str) -> tuple[str, str, int]:
    """A formatted turn -> (role, text, place where its text begins)."""
    m = _TURN.fullmatch(piece)
    if m is None:
        raise ValueError("not a formatted turn")
    mark = m.group(1)
    return (unescaped(mark[1:]) if mark.startswith("=") else _NAMES[mark]), unescaped(m.group(2)), m.start(2)


# --- Spark -------------------------------------------------------------------

TURNS = "key string, ord {ord}, at long, role string, text string, layout string, fingerprint string, paths array<string>"
PIECES = "key string, turn long, role string, piece string, start long, loss_start long, loss_end long"


def canonical_turns(spark: SparkSession, records: DataFrame, key="key", order="ord", record="record",
                    layouts: dict[str, list[tuple]] = LAYOUTS) -> DataFrame:
    """Records (JSON text, with a key and an order among records of one key) -> turns; a record without turns gives one row with a null role."""
    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps = Mappings(layouts)
        for pdf in batches:
            rows = []
            for k, o, text in zip(pdf["key"], pdf["ord"], pdf["record"]):
                try:
                    rec = json.loads(text) if text else None
                except ValueError:
                    rec = None
                layout, mark, found = maps.of(rec)
                turns = maps.turns(layout, rec) if layout else []
                shown = None if layout else sorted(found)
                rows += [(k, o, i, r, t, layout, mark, shown) for i, (r, t) in enumerate(turns or [(None, None)])]
            yield pd.DataFrame(rows, columns=["key", "ord", "at", "role", "text", "layout", "fingerprint", "paths"])

    workers_ready(spark)
    # orders travel as text, so that a null among them stays one, and come back before any sorting
    src = records.select(F.col(key).cast("string").alias("key"), F.col(order).cast("string").alias("ord"), F.col(record).alias("record"))
    kind = records.schema[order].dataType.simpleString()
    return src.mapInPandas(convert, TURNS.format(ord="string")).withColumn("ord", F.col("ord").cast(kind))


def formatted(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Turns -> pieces in order: put one after the other they are the conversation.

    ``start`` is the piece's place in the conversation in code points;
    ``loss_start`` and ``loss_end`` the span of the conversation the loss
    covers (null on turns it does not cover). The pieces of a key lie together
    and in order in one partition.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one key runs on from batch to batch: the last row says whether it is still the same
        last, n, at = object(), 0, 0
        for pdf in batches:
            rows = []
            for k, role, text in zip(pdf["key"], pdf["role"], pdf["text"]):
                if k != last:
                    last, n, at = k, 0, 0
                    if role is None:
                        rows.append((k, -1, None, "", 0, None, None))
                if role is None:
                    continue
                head, body = head_of(role), escaped(text)
                piece = head + body + _TAIL
                lo = at + len(head)
                rows.append((k, n, role, piece, at, *((lo, lo + len(body)) if role == LEARNED else (None, None))))
                n, at = n + 1, at + len(piece)
            out = pd.DataFrame(rows, columns=["key", "turn", "role", "piece", "start", "loss_start", "loss_end"])
            yield out.astype({"loss_start": "Int64", "loss_end": "Int64"})

    workers_ready(spark)
    lying = (turns.where("layout is not null").select("key", "ord", "at", "role", "text").repartition("key")
                  .sortWithinPartitions("key", F.col("ord").asc_nulls_first(), "at", "role", "text"))
    return lying.select("key", "role", "text").mapInPandas(write, PIECES)


def in_order(pieces: DataFrame) -> DataFrame:
    """Pieces from a table, brought together and in order again for :func:`read_back`."""
    return pieces.repartition("key").sortWithinPartitions("key", "turn")


def read_back(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """Pieces, as :func:`formatted` leaves them -> one row per key, read from their text alone:
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            done = []
            for k, piece, at, lo, hi in zip(pdf["key"], pdf["piece"], pdf["start"], pdf["loss_start"], pdf["loss_end"]):
                if now is None or k != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(k)
                now.add(piece, at, lo, hi)
            yield pd.DataFrame(done, columns=_READ)
        if now is not None:
            yield pd.DataFrame([now.row()], columns=_READ)

    workers_ready(spark)
    return (pieces.select("key", "piece", "start", "loss_start", "loss_end")
                  .mapInPandas(read, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


_READ = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


class _Reader:
    """What is told of one conversation while its pieces pass by."""

    def __init__(self, key):
        self.key, self.n, self.chars, self.loss_chars = key, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, at: int, lo, hi) -> None:
        if at != self.chars:
            raise ValueError("pieces out of order")
        if piece:
            role, text, _ = turn_of(piece)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if not pd.isna(lo):
            learned = unescaped(piece[int(lo) - at:int(hi) - at])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
