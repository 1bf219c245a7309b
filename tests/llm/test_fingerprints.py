import hashlib
import math
import random

import xxhash
from pyspark.sql import functions as F

from tributary.llm import fingerprints as P

from .conftest import words


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def h64(words, seed=42):
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed % (1 << 64))
    return seed


def paragraphs(text):
    """The rule written out: borders at line ends, after one word in eight, and in long words after one character in 48."""
    out = []
    for w in text.split(" "):
        if len(w) > 64:
            w = "".join(c + "\x02" if signed(h64(w[max(i - 3, 0) : i + 1])) % 48 == 0 else c for i, c in enumerate(w))
        elif signed(h64([w])) % 8 == 0:
            w += "\x02"
        out.append(w)
    return {p for p in " ".join(out).replace("\n", "\x02").split("\x02") if p}


def dice(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def check(out, rows):
    rows = sorted(rows, key=lambda r: r[0])
    prints = {}
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n, q = len(text), len(text) // 4
        edited = text[: n - q] + after[:q]
        r = out[doc]
        assert r["n_chars"] == n
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = map(paragraphs, (text, edited, after))
        assert math.isclose(r["near_edited"], dice(a, e)) and math.isclose(r["near_next"], dice(a, b))
        assert (r["n_differ_edited"], r["n_differ_next"]) == (len(a ^ e), len(a ^ b))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    by_print = {}
    for t, f in prints.items():
        assert paragraphs(by_print.setdefault(f, t)) == paragraphs(t)


def test_columns_equal_brute_force(docs, corpus, no_docs):
    out = {r["doc_id"]: r for r in P.fingerprints(docs.withColumn("id", docs.n_chars)).collect()}
    check(out, [(r[0], r[1]) for r in corpus])
    assert P.fingerprints(no_docs).count() == 0


def test_one_document_is_its_own_next(spark):
    rows = [(7, "some text of one document that stands alone")]
    out = {r["doc_id"]: r for r in P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check(out, rows)
    assert out[7]["near_next"] == 1.0


def test_blocks_hand_over_their_first_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_DOCS", 90)
    rows = [(i * i - 50, f"t{i}") for i in range(599)] + [(1 << 60, "far")]
    for rows in (rows, [(None, "none"), *rows]):
        n = len(rows)
        placed = P.with_next(spark.createDataFrame(rows, "id long, text string"))
        assert {(r["id"], r["next_text"]) for r in placed.collect()} == {(d, rows[(k + 1) % n][1]) for k, (d, _) in enumerate(rows)}


def test_small_edits_leave_likeness_high_at_every_length(spark):
    rng = random.Random(8)
    for unspaced in (False, True):
        base = []
        for n in range(1000, 10_001, 300):
            text = ""
            while len(text) < n:
                text += "".join(words(rng, 200)) if unspaced else " ".join(words(rng, 14)) + rng.choice(["\n", " ", " "])
            base.append(text[:n])
        for edit in (lambda t: "x" + t, lambda t: t + "\n" + " ".join(words(rng, 9)), lambda t: t + "1234567890"):
            rows = [(k, t, edit(t)) for k, t in enumerate(base)]
            df = P.with_paragraphs(spark.createDataFrame(rows, "id long, a string, b string"), {"a": "ka", "b": "kb"})
            df = df.select("*", *(F.expr(P.sketch(k, f"{P.CELLS}L")).alias(s) for k, s in (("ka", "sa"), ("kb", "sb"))))
            out = P.compared(df, "ka", "kb", "sa", "sb", "d").select("ka", "kb", "d.ok", P.differing("d", "ka", "kb").alias("n")).select(P.dice("n", "ka", "kb").alias("near"), "ok").collect()
            assert min(r["near"] for r in out) >= 0.8


def test_a_very_long_text_and_an_edit_of_all_of_it(spark):
    rng = random.Random(9)
    rows = [(1, " ".join(words(rng, 60_000))), (2, " ".join(words(rng, 50_000))), (3, "\U0001f600é" * 20_000)]
    check({r["doc_id"]: r for r in P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}, rows)


def test_peeling_recovers_or_says_no(spark):
    keys = spark.range(40).select(F.expr("transform(sequence(1, id + 1), x -> xxhash64(id, x)) as a"), F.expr("transform(sequence(1, 41 - id), x -> xxhash64(x)) as b"))
    for cells in ("32L", "8L"):
        t = keys.withColumn("t", F.expr(P.peel(P.subtract(P.sketch("a", cells), P.sketch("b", cells)), cells)))
        for r in t.collect():
            if r["t"]["ok"]:
                assert {(x["n"], x["k"]) for x in r["t"]["found"]} == {(1, k) for k in r["a"]} | {(-1, k) for k in r["b"]}
            else:
                assert cells == "8L" or len(r["a"]) + len(r["b"]) > 40


def test_retries_recover_all_differences(spark):
    """Pairs of up to 900 differing digests, which the base sketch cannot hold: each table peels or is tried again, and the digests are those of the texts."""
    rows = spark.range(1200).selectExpr("id", "sort_array(transform(sequence(0, id % 451), x -> xxhash64(id, x))) as a", "sort_array(transform(sequence(id % 7, 450), x -> if(x < id % 451 and id % 5 = 0, xxhash64(id, x), xxhash64(x)))) as b")
    df = rows.select("*", *(F.expr(P.sketch(k, f"{P.CELLS}L")).alias(s) for k, s in (("a", "sa"), ("b", "sb")))).localCheckpoint()
    for r in P.compared(df, "a", "b", "sa", "sb", "d").select("a", "b", "d").collect():
        a, b = set(r["a"]), set(r["b"])
        assert r["d"]["ok"] and {(x["n"], x["k"]) for x in r["d"]["found"]} == {(1, k) for k in a - b} | {(-1, k) for k in b - a}


def test_cells_and_peeling_equal_brute_force(spark):
    """Cells dealt to in two steps hold what lies there; all single digests of a round go, those in several subtables once."""
    rng = random.Random(8)
    keys = [signed(rng.getrandbits(64)) for _ in range(60)]
    df = spark.createDataFrame([(keys[:40], keys[20:])], "a array<long>, b array<long>")
    row = df.selectExpr(f"{P.sketch('a', '32L')} as s", f"{P.peel(P.subtract(P.sketch('a', '32L'), P.sketch('b', '32L')), '32L')} as p", f"{P.peel(P.filled(P.signed('a'), '4L', 1), '4L', 1)} as full").first()
    for t in range(3):
        cells = [[0, 0, 0] for _ in range(32)]
        for k in keys[:40]:
            c = cells[(k >> 20 * t) & 31]
            c[0], c[1], c[2] = c[0] + 1, c[1] ^ k, c[2] ^ signed(xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), seed=42))
        assert [list(c) for c in row["s"][f"t{t}"]] == cells
    assert row["p"]["ok"] and sorted(map(tuple, row["p"]["found"])) == sorted([(1, k) for k in keys[:20]] + [(-1, k) for k in keys[40:]])
    assert not row["full"]["ok"]  # 40 digests in 12 cells


def test_peeling_goes_on_while_it_finds_digests(spark):
    """72 digests whose peeling needs more than 18 steps of one subtable each."""
    rng = random.Random(7)
    df = spark.createDataFrame([([signed(rng.getrandbits(64)) for _ in range(72)],)], "a array<long>")
    row = df.selectExpr("a", f"{P.peel(P.sketch('a', '32L'), '32L')} as p").first()
    assert row["p"]["ok"] and sorted(x["k"] for x in row["p"]["found"]) == sorted(row["a"])
