import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tributary.llm import packing, token_counts
from tributary.llm.tokens import byte_bpe, default_path

PATH = default_path()
ALPHABET = [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "a", "the", "'s", "'re", "'", "é", "1", "½", "漢", "😀", "<|endoftext|>", "!", "...", "\x00", "foo", "​", " is"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_ids_equal_the_library(library):
    bpe = byte_bpe(PATH)
    for t in texts(600):
        assert list(bpe.ids(t)) == library.encode(t, add_special_tokens=False).ids


def test_every_prefix_count_equals_encoding_it_again():
    bpe = byte_bpe(PATH)
    for t in texts(150, 2):
        table = token_counts.PrefixTable(bpe, t)
        counts = [len(bpe.ids(t[:k])) for k in range(len(t) + 1)]
        assert [table.count(k) for k in range(len(t) + 1)] == counts
        for limit in (0, 1, 3, 7):
            assert table.longest(limit) == max(k for k, n in enumerate(counts) if n <= limit)


@pytest.mark.parametrize(("known", "chars"), [(800_000, 16_000_000), (40, 16_000_000), (800_000, 60)])
def test_words_answer_as_the_whole_table(monkeypatch, known, chars):
    monkeypatch.setattr(token_counts, "KNOWN", known)
    monkeypatch.setattr(token_counts, "KNOWN_CHARS", chars)
    monkeypatch.setattr(token_counts, "SLICE", 50)
    bpe = byte_bpe(PATH)
    plain = [a for a in ALPHABET if a.isprintable() and a.strip() and a[0] != "<" or a in (" ", "\n", "\x1c", "\x00")]
    rng = random.Random(8)
    some = texts(300, 9) + ["".join(rng.choice(plain) for _ in range(rng.randrange(25))) for _ in range(600)] + ["", " ", "\n", " a", "\na", "a " + "x" * 100]
    tables = [token_counts.PrefixTable(bpe, t) for t in some]
    for limit in (0, 1, 3, 7):
        words = token_counts.Words(bpe)
        assert words.answers(some, limit).tolist() == [[t.n_tokens, t.longest(limit)] for t in tables]
    assert sum(words.split(t) is not None for t in some) > 300


def test_the_programme_goes_on_from_shared_bytes():
    bpe = byte_bpe(PATH)
    pieces = sorted({" " + "".join(x) for x in zip("tesé漢" * 40, "ringa" * 40, "ostal" * 40, "nerv" * 50)} | {"'s", " te", " test", "1234567", "漢字"}, key=str.encode)
    for piece, counts in zip(pieces, token_counts.ordered_counts(bpe, [p.encode() for p in pieces])):
        assert counts == [len(bpe.ids(piece[: k + 1])) for k in range(len(piece))]


def test_a_megabyte_without_white_space_is_linear():
    bpe = byte_bpe(PATH)
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", "c1", "!", "é", "漢", "<|endoftext|>"]) for _ in range(500_000))
    table = token_counts.PrefixTable(bpe, text)
    assert table.n_tokens == len(bpe.ids(text)) and len(table.counts) == len(text) + 1
    for k in rng.sample(range(len(text)), 3):
        assert table.count(k) == len(bpe.ids(text[:k]))
    one = "x" * 300_000  # one pre-token
    assert token_counts.PrefixTable(bpe, one).n_tokens == len(bpe.ids(one))


def test_counts_of_documents(docs, corpus, no_docs, library):
    out = {r["doc_id"]: r for r in token_counts.count_tokens(docs.withColumn("n_tokens", docs.doc_id), PATH, 100).collect()}
    assert len(out) == len(corpus)
    for doc, text, *_ in corpus:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = out[doc]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((text or "").encode()), n, n > 100)
        assert len(library.encode((text or "")[: r["fit_chars"]], add_special_tokens=False).ids) <= 100
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


def test_packing_holds_every_id_once(docs, corpus, library):
    out = packing.pack(docs, PATH, seq_len=256, group_docs=16).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for doc, text, *_ in corpus:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(pieces[doc], key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for rows in bins.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows)])[:-1].tolist()
        assert sum(r["length"] for r in rows) <= 256


def test_packing_of_nothing_and_of_null_ids(spark, no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["length"]) for r in packing.pack(rows, PATH).collect()) == [(-1, 3), (-1, 3), (7, 1)]


def test_tournament_is_first_fit():
    rng = random.Random(3)
    tree, free = packing.Tournament(100), []
    for size in sorted((rng.randrange(1, 100) for _ in range(500)), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= size), None)
        if at is None:
            free.append(100)
            at = len(free) - 1
        assert tree.place(size) == (at, 100 - free[at])
        free[at] -= size
