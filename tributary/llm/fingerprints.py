"""Document fingerprints by invertible Bloom lookup sketches (operator 7).

A text is cut into paragraphs by its content alone: at line ends and after words
whose hash says so, every WORDS-th on average; in words of more than LONG characters
(text without spaces) after characters whose last four say so. The rule is the same
at every length, so an edit moves only the borders beside it. Each distinct
paragraph's 64-bit digest goes into one cell of each of three
subtables; a cell holds the number of its digests and the exclusive-or of them and
of their check hashes. Two sketches subtract cell by cell, common paragraphs cancel,
and peeling takes cells that hold one digest until none are left, which recovers
the differing digests with their sides. Where peeling stops early, both texts are
sketched again in more cells: their digests are dealt by value to as many small tables
as their number asks for, each is peeled by itself, and one that does not peel is tried
again with other and more cells. Likeness is the Dice coefficient of the paragraph
sets that the recovered differences imply.

DataFrame functions only; no Python runs on the rows. Defined cases: null and empty
texts have no paragraphs and are like each other (1.0) and unlike all others (0.0);
a single document is its own next; null ids come first and ties of id go by the
text's hash; repeated rows are returned each; an empty table gives no rows; a text
of any length is one row, its work in proportion to its paragraphs. Of the input's
columns only the id and the text are read, so the others may have any name.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "struct(0L as n, 0L as k, 0L as h)"
NONE = "filter(array(struct(0L as n, 0L as k)), c -> false)"
#: Cells of a subtable, in the published fingerprint and in each table of a retry.
CELLS = 32
#: Digests of both texts for each table of a retry, at most on average, and the cells of a subtable in its tries. A table costs something for each cell and for cells times digests; of 6, 12 and 16 digests, 12 cost least.
DEALT, TABLES = 12, (8, 16, 32)
#: Peeling rounds, at most; each takes all single digests, and none is made after one that finds none.
ROUNDS = 24
#: Cells that a digest is compared with at a time; more are dealt to in two steps.
SPAN = 8
#: Words of a paragraph on average; characters of a word from which on it is cut inside, and of its pieces on average.
WORDS, LONG, CHARS = 8, 64, 48
#: Blocks of documents, at most, that meet their next ones, and documents in one.
MAX_BLOCKS, BLOCK_DOCS = 16_384, 512


def paragraphs(text: str) -> str:
    """SQL of a text's paragraphs; char(2) marks the borders."""
    chars = "split(w, '')"
    last = "xxhash64(slice(cs, greatest(i - 2, 1), least(i + 1, 4)))"
    inside = let("cs", chars, f"array_join(transform(cs, (c, i) -> if(pmod({last}, {CHARS}) = 0, concat(c, char(2)), c)), '')")
    word = f"case when char_length(w) > {LONG} then {inside} when pmod(xxhash64(w), {WORDS}) = 0 then concat(w, char(2)) else w end"
    return f"split(array_join(transform(split({text}, ' '), w -> {word}), ' '), '[\n\u0002]')"


def with_paragraphs(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds for each text column (texts: to new name) the sorted distinct digests of its paragraphs."""
    digests = lambda t: f"sort_array(array_distinct(transform(filter({paragraphs(t)}, x -> x <> ''), x -> xxhash64(x))))"
    return df.withColumns({out: F.expr(digests(text)) for text, out in texts.items()})


def placed(digests: str, cells: str, salt: int = 0) -> str:
    """SQL that adds to each digest (n, k, h) its cell in each subtable; a salt gives other cells."""
    bits = f"xxhash64({salt}, d.k)" if salt else "d.k"
    at = ", ".join(f"cast(shiftrightunsigned({bits}, {20 * t}) & ({cells} - 1) as int) as p{t}" for t in range(3))
    return f"transform({digests}, d -> struct(d.n as n, d.k as k, d.h as h, {at}))"


def let(name: str, value: str, body: str) -> str:
    """SQL of body with a name for a value, which is so computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def signed(keys: str, n: int = 1) -> str:
    """SQL of digests as (n, k, h)."""
    return f"transform({keys}, k -> struct({n}L as n, k as k, xxhash64(k) as h))"


def with_placed(ps: str, t: int, cells: str, old: str, sign: str) -> str:
    """SQL of subtable t after the placed digests ps are added (sign: +) or taken out (-); old: SQL of its cells before, or nothing."""
    n = int(cells.rstrip("L"))
    span = min(n, SPAN)
    cell = f"{old}[j]" if old else CELL
    one = lambda ms, lo: f"transform(sequence({lo}, {lo} + {span - 1}), j -> aggregate(filter({ms}, x -> x.p{t} = j), {cell}, (a, x) -> struct(a.n {sign} x.n as n, a.k ^ x.k as k, a.h ^ x.h as h)))"
    if span == n:
        return one(ps, "0")
    none = f"slice({old}, {span} * g + 1, {span})" if old else f"array_repeat({CELL}, {span})"
    part = let("ms", f"filter({ps}, x -> shiftright(x.p{t}, {span.bit_length() - 1}) = g)", f"if(size(ms) = 0, {none}, {one('ms', f'{span} * g')})")
    return f"flatten(transform(sequence(0, {n // span - 1}), g -> {part}))"


def filled(digests: str, cells: str, salt: int = 0) -> str:
    """SQL of the cells t0, t1, t2 of an array of (n, k, h); those with opposite signs cancel, so that of two texts' digests their difference is left."""
    return let("ks", placed(digests, cells, salt), f"struct({', '.join(f'{with_placed("ks", t, cells, "", "+")} as t{t}' for t in range(3))})")


def sketch(keys: str, cells: str) -> str:
    """SQL of the sketch of an array of digests."""
    return filled(signed(keys), cells)


def subtract(a: str, b: str) -> str:
    one = lambda t: f"zip_with({a}.t{t}, {b}.t{t}, (x, y) -> struct(x.n - y.n as n, x.k ^ y.k as k, x.h ^ y.h as h)) as t{t}"
    return f"struct({', '.join(map(one, range(3)))})"


def peel(difference: str, cells: str, salt: int = 0) -> str:
    """SQL of (ok, found): found are the recovered digests k with n = 1 (first text only) or -1 (second)."""
    single = "array_distinct(filter(concat(s.t0, s.t1, s.t2), c -> abs(c.n) = 1 and xxhash64(c.k) = c.h))"
    left = ", ".join(f"{with_placed('ps', t, cells, f's.t{t}', '-')} as t{t}" for t in range(3))
    after = f"if(size(ps) = 0, struct(s.t0 as t0, s.t1 as t1, s.t2 as t2, s.found as found, false as more), struct({left}, concat(s.found, transform(ps, p -> struct(p.n as n, p.k as k))) as found, true as more))"
    start = let("d", difference, f"struct(d.t0 as t0, d.t1 as t1, d.t2 as t2, {NONE} as found, true as more)")
    done = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> if(s.more, {let('ps', placed(single, cells, salt), after)}, s))"
    return let("s", done, "struct(forall(s.t0, c -> c.n = 0 and c.k = 0 and c.h = 0) as ok, s.found as found)")


def text_of(cells: str) -> str:
    """SQL of the published form: all cells in order, empty ones blank."""
    return f"array_join(transform(concat({cells}.t0, {cells}.t1, {cells}.t2), c -> if(c.n = 0, '', concat(hex(c.n), '.', lower(hex(c.k)), '.', lower(hex(c.h))))), ',')"


def dealt(keys: str, bits: str) -> str:
    """SQL of sorted digests dealt by their leading bits to 2 ** bits arrays, in one pass: marks at the least value of each array are sorted in between."""
    marks = f"transform(sequence(0L, shiftleft(1L, {bits}) - 1L), g -> shiftleft(g, 64 - {bits}) ^ shiftleft(1L, 63))"
    is_mark = f"(x & ~shiftleft(-1L, 64 - {bits})) = 0"
    # the g-th mark at index i has i - g digests before it
    starts = f"transform(filter(transform(sort_array(concat({keys}, {marks})), (x, i) -> if({is_mark}, i, -1)), i -> i >= 0), (i, g) -> i - g)"
    return let("st", f"concat({starts}, array(size({keys})))", f"transform(sequence(0, size(st) - 2), g -> slice({keys}, st[g] + 1, st[g + 1] - st[g]))")


def again(a: str, b: str) -> str:
    """SQL of (ok, found) of sorted digest arrays from many small tables; one that does not peel is tried again by itself, with other and more cells."""
    bits = f"cast(greatest(1.0D, ceil(log2((size({a}) + size({b})) / {DEALT}.0D))) as int)"
    own = f"concat({signed('q.a')}, {signed('q.b', -1)})"
    tries = [peel(filled(own, f"{cells}L", salt), f"{cells}L", salt) for salt, cells in enumerate(TABLES)]
    one = tries.pop()
    for i, t in reversed(list(enumerate(tries))):
        one = let(f"try{i}", t, f"if(try{i}.ok, try{i}, {one})")
    parts = f"transform(arrays_zip({dealt(a, 'nb')}, {dealt(b, 'nb')}), z -> struct(z['0'] as a, z['1'] as b))"
    done = let("nb", bits, f"transform({parts}, q -> if(size(q.a) + size(q.b) = 0, struct(true as ok, {NONE} as found), {one}))")
    return let("all_", done, "struct(forall(all_, t -> t.ok) as ok, flatten(transform(all_, t -> t.found)) as found)")


def compared(df: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, out: str) -> DataFrame:
    """Adds ``out``: (ok, found) for the sorted digest arrays a and b, whose base sketches are at hand."""
    df = df.withColumn("__base", F.expr(peel(subtract(sketch_a, sketch_b), f"{CELLS}L")))
    return df.withColumn(out, F.expr(f"case when __base.ok then __base else {again(a, b)} end")).drop("__base")


def differing(diff: str, a: str, b: str) -> Column:
    """Number of digests in one text only; a pair with a table that no try could peel (two digests in the same cells each time) is settled by the digests themselves."""
    return F.expr(f"cast(if({diff}.ok, size({diff}.found), size(array_except({a}, {b})) + size(array_except({b}, {a}))) as bigint)")


def dice(n_differ: str, a: str, b: str) -> Column:
    """Likeness of two texts from the number of differing digests."""
    both = f"(size({a}) + size({b}))"
    return F.expr(f"if({both} = 0, 1.0D, ({both} - {n_differ}) / cast({both} as double))")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text) with next_text: the text of the next id, of the first after the last.

    Ids are cut into blocks at their quantiles, so that blocks hold about as many
    documents whatever the ids; a document that starts a block goes to the block
    before it as well, so every pair meets in one block and texts shuffle once.
    There are at most MAX_BLOCKS blocks, the bound of what the driver holds and of
    what is broadcast.
    """
    n = docs.count()
    blocks = min(MAX_BLOCKS, -(-n // BLOCK_DOCS))
    marks = docs.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)], 4 * blocks)).first()[0] if blocks > 1 else []
    placed = docs.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(-math.inf)))
    splits = [-math.inf, *sorted({float(x) for x in marks or []}), math.inf]
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="at", outputCol="block").transform(placed)
    else:
        placed = placed.withColumn("block", F.lit(0.0))
    placed = placed.drop("at")
    across = Window.orderBy("block")
    firsts = placed.groupBy("block").agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls"))  # MAX_BLOCKS rows at most
    last = firsts.agg(F.max("block")).first()[0]
    firsts = firsts.select(F.when(F.col("nulls") == 0, F.col("first")).alias("first"), F.coalesce(F.lag("block").over(across), F.lit(last)).alias("before"))
    both = placed.join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("first")), "left")
    both = both.select("id", "text", F.posexplode(F.when(F.col("before").isNull(), F.array("block")).otherwise(F.array("block", "before"))).alias("copy", "block"))
    order = Window.partitionBy("block").orderBy("copy", "id", F.xxhash64("text"))
    return both.withColumn("next_text", F.lead("text").over(order)).where("copy = 0").select("id", "text", F.coalesce("next_text", "text").alias("next_text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and the numbers of recovered digests.

    The edited text is the document's with its last quarter (floor) replaced by as
    much from the start of the next document.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = with_next(docs)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = with_paragraphs(rows.withColumn("edited_sha256", F.sha2("edited", 256)), {"text": "ka", "edited": "ke", "next_text": "kn"})
    rows = rows.select("id", "n_chars", "edited_sha256", "ka", "ke", "kn")
    rows = rows.select("*", *(F.expr(sketch(k, f"{CELLS}L")).alias(s) for k, s in (("ka", "sa"), ("ke", "se"), ("kn", "sn"))))
    rows = compared(rows, "ka", "ke", "sa", "se", "to_edited")
    rows = compared(rows, "ka", "kn", "sa", "sn", "to_next")
    rows = rows.withColumns({"n_differ_edited": differing("to_edited", "ka", "ke"), "n_differ_next": differing("to_next", "ka", "kn")})
    return rows.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_chars", "edited_sha256",
        F.expr(text_of("sa")).alias("fingerprint"), F.expr(text_of("se")).alias("edited_fingerprint"),
        dice("n_differ_edited", "ka", "ke").alias("near_edited"), dice("n_differ_next", "ka", "kn").alias("near_next"), "n_differ_edited", "n_differ_next",
    )
