"""Quality rules from tokeniser fertility (operator 8).

A public vocabulary with byte fallback encodes every distinct word of a batch
once. A text's characters per token, tokens per word, share of byte-fallback
tokens and token entropy must lie in the bands of its language or, where the
language has none, of its script. Base rules on words, repeats and length come first.

The bands of a language are two-sided and fitted (``fit``) to the labelled clean
documents of even id: the extremes of those rows, widened on each side by MARGIN of
their range. Entropy is compared with what clean texts of as many tokens have. The
labels have no clean text with byte-fallback tokens, so the limit of their share
and the bands of scripts are not fitted, but fixed and wide.

Defined cases: a null text has no words; texts without words fail the base rules;
null and unknown languages use the bands of the script that most letters are in;
repeated rows are judged alike; an empty table gives no rows; a text of any length is
measured in one task. Of the input's columns only the id, the text, the language and
those carried are read, so the others may have any name. Row by row: no shuffle.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Band:
    """Limits of a clean text of a script; entropy is in bits a token, relative to the most that its length allows (log2 of the tokens, at most 9)."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float


@dataclass(frozen=True)
class Fitted:
    """Limits of a clean text of a language; entropy is in bits a token, less ``expected`` of its length."""

    chars_per_token: tuple[float, float]
    tokens_per_word: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]
    #: Powers 2, 1 and 0 of log2 of the tokens, and the range of log2 that was fitted.
    curve: tuple[float, float, float]
    span: tuple[float, float]

    def expected(self, n_tokens: int) -> float:
        x = min(max(float(np.log2(max(n_tokens, 1))), self.span[0]), self.span[1])
        return (self.curve[0] * x + self.curve[1]) * x + self.curve[2]


#: Part of the clean rows' range by which a fitted limit lies beyond their extreme.
MARGIN = 0.10
#: By language code, as ``fit`` finds them, then by script, wide.
BANDS = {
    "en": Fitted((1.793, 2.484), (1.785, 2.863), 0.10, (-0.342, 0.34), (-0.03782, 0.9245, 1.28871), (6.71, 13.3)),
    "de": Fitted((2.01, 2.47), (2.1, 3.149), 0.10, (-0.313, 0.593), (-0.02868, 0.71482, 2.29022), (7.02, 13.48)),
    "fr": Fitted((1.673, 2.205), (2.18, 3.637), 0.10, (-0.308, 0.654), (-0.02912, 0.71491, 2.27331), (7.01, 13.6)),
    "es": Fitted((1.773, 2.105), (2.154, 3.052), 0.10, (-0.371, 0.733), (-0.03962, 0.94454, 1.15423), (7.1, 12.83)),
    "LATIN": Band((1.15, 9.0), 0.20, 0.50),
    "CYRILLIC": Band((1.0, 9.0), 0.30, 0.40),
    "GREEK": Band((0.7, 9.0), 0.50, 0.40),
    "HAN": Band((0.3, 9.0), 0.90, 0.40),
    "OTHER": Band((0.2, 9.0), 1.0, 0.35),
}


def fit(measured: pd.DataFrame, byte_share: float = 0.10) -> Fitted:
    """The bands of a language from the columns of COLUMNS of its clean documents."""
    rows = measured[~measured["base_failed"]]
    tokens = rows["word_chars"] / rows["chars_per_token"]
    x = np.log2(tokens)
    curve = np.polyfit(x, rows["token_entropy"], 2)

    def limits(v: pd.Series) -> tuple[float, float]:
        wide = MARGIN * (v.max() - v.min())
        return round(float(v.min() - wide), 3), round(float(v.max() + wide), 3)

    return Fitted(
        limits(rows["chars_per_token"]), limits(tokens / rows["n_words"]), byte_share, limits(rows["token_entropy"] - np.polyval(curve, x)),
        tuple(round(float(c), 5) for c in curve), (round(float(x.min()), 2), round(float(x.max()), 2)),
    )


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


def script(text: str) -> str:
    """The script of most letters among the text's distinct characters, weighted by how often they occur."""
    found: dict[str, int] = {}
    for ch in set(text):
        if ch.isalpha():
            name = "LATIN" if ch < "ɐ" else unicodedata.name(ch, "OTHER").split(" ")[0].replace("CJK", "HAN")
            found[name] = found.get(name, 0) + text.count(ch)
    top = max(found, key=lambda k: (found[k], k), default="LATIN")
    return top if top in BANDS else "OTHER"


def repeated_words(codes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    _, small = np.unique(codes, return_inverse=True)
    base = int(small.max()) + 1
    pair = np.unique(small[:-2] * base + small[1:-1], return_inverse=True)[1]
    _, inverse, counts = np.unique(pair * base + small[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def verdict(lang: str | None, text: str, n_words: int, n_tokens: int, word_chars: int, n_bytes: int, entropy: float) -> bool:
    band = BANDS.get(lang) if isinstance(lang, str) else None
    band = band or BANDS[script(text)]
    if not n_tokens:
        return False
    low, high = band.chars_per_token
    if not (low <= word_chars / n_tokens <= high and n_bytes / n_tokens <= band.byte_share):
        return False
    if isinstance(band, Band):
        most = min(9.0, np.log2(n_tokens)) if n_tokens > 1 else 1.0
        return bool(entropy / most >= band.entropy)
    (few, many), (low, high) = band.tokens_per_word, band.entropy
    return bool(few <= n_tokens / n_words <= many and low <= entropy - band.expected(n_tokens) <= high)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double"


#: Texts whose words are held at once.
SLICE = 1000


def measure(texts: list[str], langs: list[str | None], path: str) -> dict[str, list]:
    """The columns of COLUMNS for a batch of texts."""
    parts = [_measure(texts[lo : lo + SLICE], langs[lo : lo + SLICE], path) for lo in range(0, len(texts), SLICE)] or [_measure([], [], path)]
    return {k: [v for p in parts for v in p[k]] for k in parts[0]}


def _measure(texts: list[str], langs: list[str | None], path: str) -> dict[str, list]:
    sp, is_byte = vocabulary(path)
    words = [WORD.findall(t) for t in texts]
    flat = np.empty(sum(map(len, words)), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    codes, distinct = pd.factorize(flat)
    coded = sp.encode(list(distinct), num_threads=1) if len(distinct) else []
    size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    start = np.concatenate([[0], np.cumsum(size)])
    ids = np.fromiter((i for x in coded for i in x), dtype=np.int64, count=int(start[-1]))
    chars = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    bytes_ = np.add.reduceat(np.append(is_byte[ids], 0).astype(np.int64), start[:-1]) * (size > 0) if len(distinct) else size
    out: dict[str, list] = {c.split()[0]: [] for c in COLUMNS.split(", ")}
    at = 0
    for text, lang, ws in zip(texts, langs, words):
        own = codes[at : at + len(ws)]
        at += len(ws)
        n, sizes = len(ws), size[own]
        tokens = int(sizes.sum())
        where = np.repeat(start[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(tokens) if n else np.zeros(0, dtype=np.int64)
        counts = np.unique(ids[where], return_counts=True)[1]
        share = counts / max(tokens, 1)
        entropy = float(-(share * np.log2(share)).sum())
        n_bytes, n_chars = int(bytes_[own].sum()), int(chars[own].sum())
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeat = repeated_words(own)
        failed = n < 50 or 100 * repeat > 50 * n
        row = (n, n_chars, len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeat, failed, not failed and verdict(lang, text, n, tokens, n_chars, n_bytes, entropy), n_chars / tokens if tokens else 0.0, n_bytes / tokens if tokens else 0.0, entropy)
        for k, v in zip(out, row):
            out[k].append(v)
    return out


def quality(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns of COLUMNS and ``carry``: one row for each input row."""
    src = df.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate((id_col, *carry))),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
        F.col(lang_col).cast("string").alias("__lang"),
    )
    kept = [f for f in src.schema.fields if f.name[:2] != "__"]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = pd.DataFrame(measure(list(pdf["__text"]), list(pdf["__lang"]), path))
            yield pd.concat([pdf[[f.name for f in kept]], found], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", " + COLUMNS
    out = src.mapInPandas(batches, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate((id_col, *carry))), *out.columns[len(kept) :])


def keep_good(df: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that pass, with their own columns: the verdict is computed beside them, so texts do not travel back from Python."""
    spec = F.pandas_udf(_verdicts(path), "boolean")
    return df.where(spec(F.coalesce(F.col(text_col), F.lit("")), F.col(lang_col).cast("string")))


def _verdicts(path: str):
    def passes(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series(measure(list(text), list(lang), path)["kept"], index=text.index, dtype=bool)

    return passes
