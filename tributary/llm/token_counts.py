"""Exact token counts of every prefix (operator 5).

A dynamic programme over the bytes of a pre-token stores the count of each of its
prefixes: the encoding of a prefix is the encoding of a shorter prefix plus one last
token, and a token may follow another exactly if the two encode to themselves when
joined. It runs once for each distinct pre-token that a worker remembers, in byte
order, so that each goes on from what it shares with the one before. A text's table is then its pre-tokens' counts on top of the running sum of those before, and
n_tokens, over_limit and the longest prefix within a limit are read from that table.
Texts without runs of white space, the most, are cut before each space and line end,
which no pre-token crosses: their table stays in two levels, the running sums of the
words and the prefix table of each distinct word.

Three prefixes need more than the sum. One that ends with a run of white space has
that run as one pre-token. A part of a contraction is two pre-tokens. A text is cut
at special strings, each of which is one token, and a prefix that ends inside one
has its characters as ordinary text.

Null texts count as empty; empty texts have no tokens; an empty table gives no rows;
repeated rows are counted each. The time is linear in a text, white space or none,
except that a pre-token costs its bytes times the longest token; memory follows the
longest text of a batch. Of the input's columns only the id and the text are read,
so the others may have any name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.tokens import PATTERN, WHITE, byte_bpe

_PIECE = regex.compile(PATTERN)
#: A run of white space whose last character goes to the next pre-token.
_RUN = re.compile(f"[{WHITE}]{{2,}}(?=[^{WHITE}])")
#: White space that keeps a text from being cut at spaces and line ends: runs, and characters other than these two.
_ODD = re.compile(f"[{WHITE}][{WHITE}]|[^\\S \\n\x1c-\x1f]")
#: Distinct pre-tokens, and words, whose counts a worker remembers; characters of the longest pre-token, and of all words.
KNOWN, LONGEST, KNOWN_CHARS = 800_000, 64, 16_000_000
#: Texts whose words are held at once.
SLICE = 500


class PrefixTable:
    """The token count of every prefix of one text, by code points; answers counts and truncations without encoding."""

    def __init__(self, bpe, text: str):
        self.counts = np.concatenate([np.zeros(1, np.int64), *parts_counts(bpe, text)])
        self.n_tokens = int(self.counts[-1])

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        return int(self.counts[min(max(chars, 0), len(self.counts) - 1)])

    def longest(self, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens."""
        return len(self.counts) - 1 - int(np.argmax(self.counts[::-1] <= limit))


class Words:
    """The prefix tables of the words that a worker has met, a word being what lies between spaces or line ends and the one before it."""

    def __init__(self, bpe):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.code_of, self.tables, self.chars, self.pieces = {}, [], 0, {}
        self.totals, self.least, self.sizes = array("q"), array("q"), array("q")

    def forget(self) -> None:
        """Drops the words and pre-tokens learnt last; those met first, among them the frequent ones, stay."""
        keep = KNOWN // 2
        if self.chars > KNOWN_CHARS:  # long words
            return self.clear()
        for known in (self.code_of, self.pieces):
            for word in list(known)[keep:]:
                del known[word]
        for kept in (self.tables, self.totals, self.least, self.sizes):
            del kept[keep:]
        self.chars = sum(self.sizes)

    def split(self, text: str) -> list[str] | None:
        """A text's words; None where pre-tokens may cross words or special strings occur."""
        if _ODD.search(text) or (self.bpe.special and special_strings(self.bpe).search(text)):
            return None
        words = text.replace("\n", " \n").split(" ")
        if words[0]:
            words[0] = "\r" + words[0]  # no space before it
        else:  # the text is empty or begins with white space
            del words[0]
        return words

    def learn(self, words: set[str]) -> None:
        """Adds the tables of new words; their new pre-tokens in order, so that each starts from what it shares with the one before."""
        plain = [w if w[:1] == "\n" else w[1:] if w[:1] == "\r" else " " + w for w in words]
        found = [_PIECE.findall(w) if len(w) <= LONGEST else () for w in plain]
        fresh = sorted({p.encode() for own in found for p in own if p not in self.pieces})
        self.pieces.update(zip([raw.decode() for raw in fresh], map(bytes, ordered_counts(self.bpe, fresh))))
        for word, text, own in zip(words, plain, found):
            if len(own) == 1:
                counts = self.pieces[own[0]]
            elif own:
                counts, base = [], 0
                for piece in own:
                    counts += [base + n for n in self.pieces[piece]]
                    base = counts[-1]
                counts = bytes(counts)
            else:
                counts = plain_counts(self.bpe, text)
            self.code_of[word] = len(self.tables)
            self.tables.append(counts)
            self.totals.append(int(counts[-1]))
            self.least.append(int(min(counts)))
            self.sizes.append(len(text))
            self.chars += len(text)

    def answers(self, texts: list[str], limit: int) -> np.ndarray:
        """n_tokens and the code points of the longest prefix of at most ``limit`` tokens of each text."""
        out = np.empty((len(texts), 2), dtype=np.int64)
        for lo in range(0, len(texts), SLICE):
            if len(self.tables) > KNOWN or self.chars > KNOWN_CHARS:
                self.forget()
            part = texts[lo : lo + SLICE]
            split = [self.split(t) for t in part]
            self.learn(set().union(*filter(None, split)).difference(self.code_of))
            totals, least, sizes = (np.array(x, dtype=np.int64) for x in (self.totals, self.least, self.sizes))
            for k, (text, words) in enumerate(zip(part, split), lo):
                if words is None:
                    table = PrefixTable(self.bpe, text)
                    out[k] = table.n_tokens, table.longest(limit)
                    continue
                codes = np.fromiter(map(self.code_of.__getitem__, words), dtype=np.int64, count=len(words))
                own = totals[codes]
                n = int(own.sum())
                out[k] = n, len(text) if n <= limit else self.longest(codes, own, least, sizes, limit)
        return out

    def longest(self, codes: np.ndarray, own: np.ndarray, least: np.ndarray, sizes: np.ndarray, limit: int) -> int:
        before = np.cumsum(own) - own
        some = np.flatnonzero(before + least[codes] <= limit)  # the words that a prefix within the limit ends in
        if not len(some):
            return 0
        at = some[-1]
        inside = [i for i, n in enumerate(self.tables[codes[at]]) if n <= limit - before[at]][-1]
        return int(sizes[codes[:at]].sum()) + inside + 1


def words_of(bpe) -> Words:
    """What this worker has learnt, in earlier tasks too."""
    if not hasattr(bpe, "_words"):
        bpe._words = Words(bpe)
    return bpe._words


def parts_counts(bpe, text: str) -> list[np.ndarray]:
    """Counts of a text's prefixes in order, in parts that end at special strings."""
    out, at, base = [], 0, 0
    for m in special_strings(bpe).finditer(text) if bpe.special else ():
        plain = text[at : m.start()]
        own = plain_counts(bpe, plain)
        # inside the string, the part before and what there is of it are ordinary text
        inside = plain_counts(bpe, plain + m.group())[len(plain) : -1]
        base_after = base + (int(own[-1]) if len(own) else 0) + 1
        out += [base + own, base + inside, np.array([base_after])]
        at, base = m.end(), base_after
    out.append(base + plain_counts(bpe, text[at:]))
    return out


def special_strings(bpe) -> re.Pattern:
    if not hasattr(bpe, "_specials"):
        bpe._specials = re.compile("|".join(re.escape(s) for s in sorted(bpe.special, key=len, reverse=True)))
    return bpe._specials


def plain_counts(bpe, text: str) -> np.ndarray:
    """Count of every prefix of a text without special strings, shortest first, the empty one left out."""
    known = bpe.__dict__.setdefault("_known", {})
    found = []
    for piece in _PIECE.findall(text):
        counts = known.get(piece)
        if counts is None:
            counts = np.array(piece_counts(bpe, piece), dtype=np.int64)
            if len(piece) <= LONGEST:
                if len(known) >= KNOWN:
                    known.clear()
                known[piece] = counts
        found.append(counts)
    if not found:
        return np.zeros(0, np.int64)
    flat = np.concatenate(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes)
    totals = flat[ends - 1]
    out = flat + np.repeat(np.cumsum(totals) - totals, sizes)
    for m in _RUN.finditer(text):  # a prefix that ends with the run has all of it as one pre-token
        before = int(out[m.start() - 1]) if m.start() else 0
        out[m.end() - 1] = before + piece_counts(bpe, m.group())[-1]
    return out


def piece_counts(bpe, piece: str) -> list[int]:
    """Count of every prefix of one pre-token, by code points."""
    return next(ordered_counts(bpe, [piece.encode()]))


def ordered_counts(bpe, pieces: list[bytes]) -> Iterator[list[int]]:
    """Counts of every prefix of each pre-token, by code points; the programme goes on from the bytes shared with the pre-token before."""
    ranks, longest, before = bpe.ranks, bpe_longest(bpe), b""
    last, count, start = [b""], [0], [0]  # of each prefix of ``before``: the last token, the tokens, and where the last one begins
    for raw in pieces:
        if raw[:1] == b"'" and len(raw) > 1 and (piece := raw.decode())[1].isalpha():  # a part of a contraction is two pre-tokens
            yield [len(bpe.ids(piece[:i])) for i in range(1, len(piece) + 1)]
            continue
        same = 0
        for x, y in zip(raw, before):
            if x != y:
                break
            same += 1
        del last[same + 1 :], count[same + 1 :], start[same + 1 :]
        for j in range(same + 1, len(raw) + 1):
            # one token only can be the last; most often the one before has grown or the new byte is alone
            grown = start[j - 1]
            for i in (grown, j - 1, *range(max(0, j - longest), grown), *range(grown + 1, j - 1)):
                tok = raw[i:j]
                if tok in ranks and j - i <= longest and joins(bpe, last[i], tok):
                    break
            last.append(tok)
            count.append(count[i] + 1)
            start.append(i)
        before = raw
        yield count[1:] if raw.isascii() else [n for n, byte in zip(count[1:], [*raw[1:], 0]) if byte & 0xC0 != 0x80]


def bpe_longest(bpe) -> int:
    if not hasattr(bpe, "_longest"):
        bpe._longest = max(map(len, bpe.ranks))
    return bpe._longest


def joins(bpe, left: bytes, right: bytes) -> bool:
    """Whether the merge loop leaves the two tokens apart and whole."""
    memo = bpe.__dict__.setdefault("_joins", {})
    found = memo.get((left, right))
    if found is None:
        if len(memo) > 400_000:
            memo.clear()
        if left and left + right not in bpe.ranks:
            found = bpe.merges(left + right) == [bpe.ranks[left], bpe.ranks[right]]  # the same loop, compiled
        else:
            found = merged(bpe, left + right) == [t for t in (left, right) if t]
        memo[left, right] = found
    return found


def merged(bpe, raw: bytes) -> list[bytes]:
    """The merge loop on raw bytes, which need not be whole characters."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, i = min((bpe.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens, over_limit and fit_chars (the longest prefix within ``limit`` tokens) of every text.

    One row for each input row, repeated rows included; other input columns are
    not read. Runs where the rows lie: no shuffle.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_of(byte_bpe(path))
        for pdf in it:
            rows = words.answers(list(pdf["text"]), limit)
            n_bytes = [len(text.encode()) for text in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": n_bytes, "n_tokens": rows[:, 0], "over_limit": rows[:, 0] > limit, "fit_chars": rows[:, 1]})

    src = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = src.mapInPandas(batches, "id string, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), *out.columns[1:])
