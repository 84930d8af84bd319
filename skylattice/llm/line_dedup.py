"""Line deduplication by a segment-partition edit join, in DataFrame functions.

A line is removed if an equal line stands earlier, or if it is the first of its kind and a line within
`edits` edits of it stands earlier; earlier means a smaller (doc_id, line number). Lines shorter than
`shortest` characters stay: blank lines, brackets and headings repeat in every text and belong there.
Only lines of at least `fuzzy` characters are compared by edits.

Two lines within k edits share one of k + 1 even segments of either of them, at a place that its number
and the difference in length bound (multi-match-aware choice), and what is left and right of it is within
k edits as well. So every line's segments are indexed by (length, number, hash), and the substrings of other
lines that can meet them probe the index, of which a key keeps only its least and greatest line. The rows of
keys that meet another line are all that goes on. Keys of more than TILE rows are split by the segments of
what remains of their lines, once more by the same rule. Of two lines that meet, one has the key as its own
segment, so a group is its own rows against all of it; own rows beyond TILE go into tiles. Semi-joins look for
one earlier line: their condition strips what both lines begin and end with, and runs a bit-parallel automaton
over the band of 2k + 1 diagonals on what is left.

Cases: a null text stays null and has no lines; an empty text has one empty line; a line's trailing
carriage return and blanks don't count; of rows that repeat a doc_id, lines with one number count as
standing at one place, neither before the other; a null doc_id comes first; other columns are kept, whatever
their names; an empty table gives an empty result. A document keeps its row even if all its lines go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import drop_stage, fresh, release_shuffles, stage

#: Rows of a key that have it as their own segment and are compared with all its rows in one group.
TILE = 64


def edges(length: str, edits: int) -> list[str]:
    """SQL for where the even segments of a line begin, and its end; the last ones take the remainder."""
    k = edits + 1
    return ["0", *(f"int({i} * (({length}) div {k}) + greatest(({length}) % {k} - {k - i}, 0))" for i in range(1, k)), f"int({length})"]


def slots(edits: int) -> list[tuple[int, int, int]]:
    """(less, number, shift): the substrings of a line that can meet segment `number` of a line that is
    shorter by `less`, so many characters behind its place there. Its own segments are those with 0 and 0."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + edits - i)
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def _own(slot: tuple[int, int, int]) -> bool:
    return slot[0] == 0 and slot[2] == 0


def _place(slot: tuple[int, int, int]) -> tuple[str, str]:
    """SQL for the start, from 0, and the size of a slot."""
    less, i, shift = slot
    return f"(e{less}_{i} + {shift})", f"(e{less}_{i + 1} - e{less}_{i})"


def _key(slot: tuple[int, int, int], *more: str) -> str:
    start, size = _place(slot)
    # Four bytes a character, so that a substring needs no walk over the characters.
    return f"xxhash64({', '.join([*more, f'n - {slot[0]}', str(slot[1])])}, substring(code, 4 * {start} + 1, 4 * {size}))"


def _cut(rows: DataFrame, edits: int) -> DataFrame:
    """rows(code, ...) with n, the characters, and the edges of the segments of lines of n characters and
    fewer. A generator of one row, so that they are computed once and the keys stay small."""
    n = "length(code) div 4"
    names = [(f"e{less}_{i}", e) for less in range(edits + 1) for i, e in enumerate(edges(f"{n} - {less}", edits))]
    return rows.select("*", F.inline(F.expr(f"array(struct(int({n}) as n, " + ", ".join(f"{e} as {name}" for name, e in names) + "))")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shared(a: Column, b: Column, from_end: bool) -> Column:
    """How many characters a and b share at the start (or end): by halving steps."""
    most = F.least(F.length(a), F.length(b))

    def equal(k: Column) -> Column:
        if from_end:
            return F.substring(a, F.length(a) - k + 1, k) == F.substring(b, F.length(b) - k + 1, k)
        return F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)

    steps = F.array(*(F.lit(1 << i) for i in range(20, -1, -1)))
    # Steps start at half a million characters; what a longer line shares beyond twice that is left to the automaton.
    return F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= most) & equal(F.least(k + s, most)), k + s).otherwise(k))


def near(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance is so many at most. Behind what both share at the ends, a row of bits for
    each number of errors e, one bit for each diagonal, says which diagonals are reached; a character of a
    matches along its diagonal, or costs an error to replace, to drop (one diagonal down), or to insert (one up)."""
    k, width = edits, 2 * edits + 1
    mask = (1 << width) - 1

    def automaton(x: Column, y: Column) -> Column:
        """x, y: arrays of characters."""

        def step(r: Column, i: Column) -> Column:
            bits = [F.when(F.get(x, i) == F.get(y, i + F.lit(j - k)), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(width)]
            match = bits[0]
            for bit in bits[1:]:
                match = match.bitwiseOR(bit)

            def rows(m: Column) -> Column:
                out, above = None, None
                for e in range(k + 1):
                    old = F.shiftright(r, e * width).bitwiseAND(F.lit(mask))
                    row = old.bitwiseAND(m)
                    if e:
                        less = F.shiftright(r, (e - 1) * width).bitwiseAND(F.lit(mask))
                        row = row.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(above, 1)).bitwiseAND(F.lit(mask))
                    above = row
                    shifted = F.shiftleft(row, e * width)
                    out = shifted if out is None else out.bitwiseOR(shifted)
                return out

            return _let(match, rows)

        start = sum((((1 << (e + 1)) - 1) << k & mask) << (e * width) for e in range(k + 1))
        places = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))

        def last(r: Column) -> Column:
            reached = r
            for e in range(1, k + 1):
                reached = reached.bitwiseOR(F.shiftright(r, e * width))
            diagonal = F.element_at(F.array(*(F.lit(1 << j) for j in range(width))), F.size(y) - F.size(x) + k + 1)
            return reached.bitwiseAND(diagonal) != 0

        return _let(F.aggregate(places, F.lit(start), step), last)

    def letters(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))

    def inner(p: Column) -> Column:
        def ends(q: Column) -> Column:
            x = letters(F.substring(q["a"], F.lit(1), F.length(q["a"]) - q["k"]))
            y = letters(F.substring(q["b"], F.lit(1), F.length(q["b"]) - q["k"]))
            return _let(F.struct(x.alias("x"), y.alias("y")), lambda z: automaton(z["x"], z["y"]))

        return _let(F.struct(p["a"].alias("a"), p["b"].alias("b"), _shared(p["a"], p["b"], True).alias("k")), ends)

    behind = lambda text, k: F.substring(text, k + 1, F.length(text))
    whole = _let(_shared(a, b, False), lambda k: _let(F.struct(behind(a, k).alias("a"), behind(b, k).alias("b")), inner))
    return (F.abs(F.length(a) - F.length(b)) <= k) & whole


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, no, line, n), h standing for the text and n the length, without trailing blanks."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    # Trimming walks the whole line, and few lines need it.
    blank = F.endswith("raw", F.lit(" ")) | F.endswith("raw", F.lit("\t")) | F.endswith("raw", F.lit("\r"))
    line = F.when(blank, F.rtrim("raw", F.lit(" \t\r"))).otherwise(F.col("raw"))
    return parts.select("doc_id", "h", "no", line.alias("line"), F.length(line).alias("n"))


#: Bits of the filter that thins out lines before their texts are gathered: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: Letters whose counts are compared before distances are.
LETTERS = "etaoinshrdlucmfwgypbvk .,-012éäñ"


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose id may be among those of wanted (surely, if it is): by a bitmap of fixed size."""
    slot = F.pmod("id", F.lit(FILTER_BITS))
    dealt = wanted.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_bit")).repartition("_bucket")
    bits = dealt.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    # As an array, of which a row reads one element and not the whole. A word's first byte is its highest.
    bits = bits.select("_bucket", F.expr("transform(sequence(0, length(_map) div 4 - 1), i -> cast(conv(hex(substring(_map, 4 * i + 1, 4)), 16, 10) as bigint))").alias("_words"))
    held = rows.withColumn("_at", F.bitmap_bit_position(slot)).withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_bucket")
    return held.filter("(shiftright(get(_words, int(_at div 32)), int(24 - _at % 32 div 8 * 8 + _at % 8)) & 1L) = 1").drop("_at", "_bucket", "_words")


def _code(lines: DataFrame, *kept: str) -> DataFrame:
    """The columns kept of lines, and their characters in four bytes each."""
    return lines.select(*kept, F.inline(F.array(F.struct(F.encode("line", "UTF-32").alias("code")))))


def meeting(lines: DataFrame, edits: int) -> DataFrame:
    """lines(id, line): (key, id, own) of all keys under which a line meets another one that has the key as
    its own segment; own says that it is a segment of this line."""
    coded = _cut(_code(lines, "id"), edits)
    mine = ", ".join(_key(s) for s in slots(edits) if _own(s))
    held = coded.select("id", F.explode(F.expr(f"array({mine})")).alias("key"))
    # One row for each key, however many lines share it.
    index = held.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    every = ", ".join(f"struct({_key(s)} as key, {str(_own(s)).lower()} as own)" for s in slots(edits))
    probe = coded.select("id", F.inline(F.expr(f"array({every})")))
    met = probe.join(index.withColumnRenamed("key", "k").hint("shuffle_hash"), F.expr("key = k and (low <> id or high <> id)"))
    met = stage(met.select("key", "id", "own", "low"), "line-met")
    # A key's only line may have met none by its own segments.
    out = stage(met.select("key", "id", "own").union(met.select("key", F.col("low").alias("id"), F.lit(True))).groupBy("key", "id").agg(F.max("own").alias("own")), "line-keys")
    drop_stage(met)
    return out


def split(rows: DataFrame, edits: int) -> DataFrame:
    """rows(key, own, code, ...) with keys that also name a segment of what is left of the line without
    the one it shares."""
    kept = [c for c in rows.columns if c not in ("key", "own", "code")]
    places = ", ".join(f"struct({_key(s)} as k, {_place(s)[0]} as start, {_place(s)[1]} as size)" for s in slots(edits))
    found = _cut(rows, edits).select("key", "own", "code", *kept, F.inline(F.expr(f"array({places})"))).filter("k = key")
    found = found.select("key", "own", "code", "start", "size", *kept).distinct()
    rest = F.expr("concat(substring(code, 1, 4 * start), substring(code, 4 * (start + size) + 1))")
    rest = found.select("key", "own", *kept, F.inline(F.array(F.struct(rest.alias("code")))))
    every = ", ".join(f"struct({_key(s, 'key')} as finer, {str(_own(s)).lower()} and own as owned)" for s in slots(edits))
    named = _cut(rest, edits).select(*kept, F.inline(F.expr(f"array({every})")))
    return named.select(F.col("finer").alias("key"), F.col("owned").alias("own"), *kept).distinct()


def tiled(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups(key, own, id, id2, ...): all rows of keys that two rows share, in each tile of their key's own rows; and the
    own rows in their tile. A key of TILE own rows at most is one tile, and its rows need no copies."""
    tiles = groups.groupBy("key").agg(F.ceil(F.count_if("own") / TILE).cast("int").alias("tiles"), F.count("*").alias("c")).filter("c > 1 and tiles > 0").drop("c")
    dealt = groups.join(tiles, "key")
    copied = dealt.filter("tiles > 1").withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    owned = dealt.filter("own").withColumn("tile", F.expr("int(pmod(xxhash64(id, id2), tiles))"))
    return dealt.filter("tiles = 1").withColumn("tile", F.lit(0)).union(copied), owned


def near_lines(lines: DataFrame, kinds: DataFrame, edits: int, fuzzy: int) -> DataFrame:
    """lines(id, id2, line, n), kinds(id, id2, first): (id, id2) of lines with a different line within the
    edits that comes first earlier."""
    long = lines.filter(F.col("n") >= fuzzy)
    met = meeting(long, edits)
    release_shuffles(lines.sparkSession)
    needed = stage(met.select("id").distinct(), "line-needed")
    texts = _marked(long.select("id", "id2", "line"), needed).groupBy("id", "id2").agg(F.first("line").alias("line"))
    firsts = _marked(kinds.select("id", "id2", "first"), needed)
    counts = F.array(*(F.length("line") - F.length(F.replace("line", F.lit(x), F.lit(""))) for x in LETTERS))
    texts = texts.join(firsts, ["id", "id2"]).join(needed, "id", "left_semi").withColumn("letters", counts)
    rows = stage(met.join(texts, "id"), "line-rows")
    for x in (met, needed):
        drop_stage(x)
    release_shuffles(lines.sparkSession)

    sizes = rows.groupBy("key").agg(F.count("*").alias("c"), F.count_if("own").alias("owned")).filter("c > 1 and owned > 0")
    sized = rows.join(sizes, "key")
    columns = ["key", "own", "id", "id2", "first", "line", "letters"]
    finer = split(_code(sized.filter(F.col("c") > TILE), *columns), edits).select(*columns)
    groups = stage(sized.filter(F.col("c") <= TILE).select(*columns).union(finer), "line-groups")
    drop_stage(rows)
    every, owned = tiled(groups)
    # An edit changes two of the counts by one at most.
    counted = " + ".join(f"abs(p.letters[{i}] - x.letters[{i}])" for i in range(len(LETTERS)))
    plausible = f"p.key = x.key and p.tile = x.tile and x.first < p.first and abs(length(p.line) - length(x.line)) <= {edits} and {counted} <= {2 * edits}"

    def behind(later: DataFrame, earlier: DataFrame) -> DataFrame:
        return later.alias("p").join(earlier.alias("x"), F.expr(plausible) & near(F.col("p.line"), F.col("x.line"), edits), "left_semi").select("id", "id2")

    # Two own rows meet in the first of the joins, whichever is later.
    found = behind(every, owned).union(behind(owned, every.filter("not own")))
    out = stage(found.distinct(), "line-near")
    drop_stage(groups)
    return out


def removed_lines(docs: DataFrame, edits: int = 2, shortest: int = 20, fuzzy: int = 20) -> DataFrame:
    """(doc_id, h, no, near): the lines that go; near says that no equal line comes before."""
    lines = _lines(docs).filter(F.col("n") >= shortest)
    named = lines.select("doc_id", "h", "no", "line", "n", F.xxhash64("line").alias("id"), F.hash("line").alias("id2"))
    kinds = stage(named.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("times")), "line-kinds")
    release_shuffles(docs.sparkSession)
    near_ones = near_lines(named.select("id", "id2", "line", "n"), kinds.select("id", "id2", "first"), edits, fuzzy)
    hit = kinds.join(near_ones.withColumn("near", F.lit(True)), ["id", "id2"], "left").filter("times > 1 or near")
    hit = stage(hit.select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-hits")
    gone = (
        _marked(named.select("doc_id", "h", "no", "id", "id2"), hit.select("id"))
        .join(hit, ["id", "id2"])
        .filter("near or struct(doc_id, no) <> first")
        .select("doc_id", "h", "no", F.expr("near and struct(doc_id, no) = first").alias("near"))
        .distinct()
    )
    out = stage(gone, "line-gone")
    for x in (kinds, near_ones, hit):
        drop_stage(x)
    release_shuffles(docs.sparkSession)
    return out


def drop_repeated_lines(docs: DataFrame, edits: int = 2, shortest: int = 20, fuzzy: int = 20, counts: bool = False) -> DataFrame:
    """docs with the lines that go taken out of text, and all columns. counts: adds _n_lines, _n_removed
    and _n_near, in place of columns of these names."""
    names = list(docs.columns)
    key, h, gone, near_count, lines, edges = fresh(names, "key", "h", "gone", "near", "lines", "edges")
    found = removed_lines(docs, edits, shortest, fuzzy).groupBy(F.col("doc_id").alias(key), F.col("h").alias(h))
    found = found.agg(F.sort_array(F.collect_list("no")).alias(gone), F.count_if("near").cast("long").alias(near_count))
    joined = docs.join(found.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h)), "left")
    # The runs of lines between those that go.
    kept = F.expr(f"flatten(transform(sequence(0, size({gone})), k -> slice({lines}, {edges}[k] + 2, {edges}[k + 1] - {edges}[k] - 1)))")
    some = F.col(gone).isNotNull() & F.col("text").isNotNull()
    joined = joined.withColumn(lines, F.when(some, F.split("text", "\n")))
    joined = joined.withColumn(edges, F.when(some, F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines)))))
    text = F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    if counts:
        there = lambda value: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.coalesce(value, F.lit(0))).cast("long")
        more = {"_n_lines": F.regexp_count("text", F.lit("\n")) + 1, "_n_removed": F.when(some, F.size(gone)), "_n_near": F.col(near_count)}
        columns = [c for c, name in zip(columns, names) if name not in more] + [there(v).alias(k) for k, v in more.items()]
    return joined.select(*columns)
