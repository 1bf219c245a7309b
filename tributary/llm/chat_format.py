"""Chat formatting by schema fingerprints (operator 6).

A record's nested field paths are hashed; the hash selects a declarative mapping
that yields canonical (role, text) turns. A template marks turns; control strings
inside texts are escaped so that the texts read back exactly.

Defined cases: null texts are empty, null roles are "user"; a record whose field
paths match no layout gives no turns and its fingerprint with layout null; ties
of turn order go by role, then text; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, path of its text) in order; or ``each``: (path of the list, path of role, path of text) inside it."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [p for _, p in self.turns] if self.each is None else [f"{self.each[0]}[].{p}" for p in self.each[1:]]


#: Layouts in use in public instruction data; roles inside lists are canonicalised by ROLES.
LAYOUTS = (
    Layout("turn", turns=(("@role", "text"),)),
    Layout("message", turns=(("@role", "content"),)),
    Layout("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt_completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("question_answer", turns=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")), optional=("system", "input")),
    Layout("messages", each=("messages", "role", "content"), turns=(("system", "system"),), optional=("system",)),
    Layout("conversations", each=("conversations", "from", "value"), turns=(("system", "system"),), optional=("system",)),
    Layout("nested_messages", each=("data.messages", "author.role", "content.text")),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(value, at: str = "") -> set[str]:
    """Leaf paths of a nested record; list items share ``[]``. An empty list shows its own path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[dict[str, Layout], set[str]]:
    """Fingerprint to layout, for every choice of its optional fields; and all paths that any layout reads."""
    out: dict[str, Layout] = {}
    known: set[str] = set()
    for lay in layouts:
        own = [q for _, p in lay.turns for q in p.split("+")]
        own += ["role"] if any(r == "@role" for r, _ in lay.turns) else []
        base = set(own) | ({f"{lay.each[0]}[].{p}" for p in lay.each[1:]} if lay.each else set())
        known |= base
        for n in range(len(lay.optional) + 1):
            for left_out in itertools.combinations(lay.optional, n):
                out.setdefault(fingerprint(base - set(left_out)), lay)
    return out, known


def dig(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def canonical(record, layouts: dict[str, Layout], known: set[str]) -> tuple[str, str | None, list[tuple[str, str]]]:
    """Fingerprint, layout name and turns of a record. Paths that no layout reads do not count."""
    print_ = fingerprint(field_paths(record) & known if isinstance(record, dict) else set())
    lay = layouts.get(print_)
    if lay is None:
        return print_, None, []
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    named = lambda r: ROLES.get(r, r) if isinstance(r, str) else "user"
    turns = []
    for role, path in lay.turns:
        found = [dig(record, p) for p in path.split("+")]
        if role == "@role":
            turns.append((said(record.get("role")) or "user", said(found[0])))
        elif any(v is not None for v in found):
            turns.append((role, "\n".join(said(v) for v in found if v)))
    if lay.each:
        turns += [(named(dig(x, lay.each[1])), said(dig(x, lay.each[2]))) for x in dig(record, lay.each[0]) or []]
    return print_, lay.name, turns


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template, and the span of its text; the span is under the loss mask if the assistant speaks."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


FORMATTED = "key string, pos long, part long, fingerprint string, layout string, role string, formatted string, loss_from long, loss_to long"


def format_records(df: DataFrame, key: str, order: str, record: str) -> DataFrame:
    """One row for each canonical turn of each JSON record: its formatted text and loss span (null: no loss).

    Row by row, so nothing shuffles and no conversation is held whole. A record
    that matches no layout gives one row with null layout, role and text.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts, known = registry()
        for pdf in it:
            rows = []
            for k, pos, raw in zip(pdf["key"], pdf["pos"], pdf["record"]):
                try:
                    record_ = json.loads(raw) if raw is not None else None
                except ValueError:
                    record_ = None
                print_, name, turns = canonical(record_, layouts, known)
                for part, (role, text) in enumerate(turns):
                    out, a, b = render(role, text)
                    loss = (a, b) if role == "assistant" else (None, None)
                    rows.append((k, pos, part, print_, name, role, out, *loss))
                if not turns:
                    rows.append((k, pos, 0, print_, name, None, None, None, None))
            out = pd.DataFrame(rows, columns=["key", "pos", "part", "fingerprint", "layout", "role", "formatted", "loss_from", "loss_to"])
            yield out.astype({"pos": "Int64", "loss_from": "Int64", "loss_to": "Int64"})

    src = df.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("pos"), F.col(record).alias("record"))
    return src.mapInPandas(batches, FORMATTED)


def digest(formatted: DataFrame, key: str = "conv_id", kind: str = "long") -> DataFrame:
    """Reads every formatted conversation back and hashes its turns and the text under its loss mask.

    Turns of a conversation stream through one task in order; only the running
    hashes are held, however long the conversation is.
    """
    columns = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_ = None, False
        for pdf in it:
            done = []
            for k, out, a, b in zip(pdf["key"], pdf["formatted"], pdf["loss_from"], pdf["loss_to"]):
                if not open_ or k != at:
                    if open_:
                        done.append((at, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    at, open_, n, chars, size = k, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if out is None:
                    continue
                size += len(out)
                for role, text in read_back(out):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if a == a and a is not None:
                    text = unescape(out[int(a) : int(b)])
                    chars += len(text)
                    loss.update(text.encode())
            yield pd.DataFrame(done, columns=columns)
        if open_:
            yield pd.DataFrame([(at, n, turns.hexdigest(), chars, loss.hexdigest(), size)], columns=columns)

    dealt = formatted.repartition("key").sortWithinPartitions("key", "pos", "part", "role", "formatted")
    out = dealt.mapInPandas(batches, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.col("key").cast(kind).alias(key), *out.columns[1:])
