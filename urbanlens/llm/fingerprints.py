"""Document fingerprints by winnowing, on DataFrame functions only.

A text's units are its runs of characters other than ASCII white space; of runs longer than ``UNIT`` characters, and in
scripts that are written without spaces, every character is a unit, so that passages there match at any offset. Hashes
stand for every K units in a row, and of every WINDOW hashes in a row the least is selected, the rightmost among equals,
with its position. Selected hashes and positions are the fingerprint. Two texts that share K + WINDOW - 1 units in a row
share a selected hash, and none is shared for less than K units (but for chance, of 64-bit hashes).

Both are made by doubling: a gram's hash is that of two neighbouring hashes of half as many units, and a window's place
that of the lesser of two half windows' places. In native functions this stands for rolling hashes and a running minimum:
log2(K) and log2(WINDOW) passes over the units.

Results by case: a null or empty text, or one of white space only, has an empty fingerprint; with fewer than K units
all of them are one hash; with fewer than WINDOW hashes the least of all is selected; equal texts have equal
fingerprints; two empty fingerprints are alike (1), an empty and another aren't (0). Rows of equal ids keep an order
by text; null ids come last; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanlens.llm.common import ASCII_SPACE, shuffle_partitions

UNIT, K, WINDOW = 16, 4, 16
#: The code points of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han), as the inside
#: of a character class. Ranges, as a script's name would be looked up for every character.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
_ONE = rf"[^{ASCII_SPACE}{UNSPACED}]"
#: A whole run of up to UNIT characters, else one character.
UNITS = rf"((?<!{_ONE}){_ONE}{{1,{UNIT}}}+(?!{_ONE})|[^{ASCII_SPACE}])"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(a: Column, width: int, join) -> Column:
    """Of every ``width`` (a power of two) neighbours their value under ``join``, by doubling; the last ones have fewer."""
    def doubled(by: int):
        # a function of one argument: a second one would be the element's index
        return lambda x: F.zip_with(x, F.slice(x, F.lit(by + 1), F.greatest(F.size(x) - by, F.lit(0))), join)

    by = 1
    while by < width:
        a = _let(a, doubled(by))
        by *= 2
    return a


def _whole(a: Column, width: int) -> Column:
    """Without the last ``width`` - 1, of which each has too few neighbours; the first stays if there is one."""
    return _let(a, lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - (width - 1), F.least(F.size(x), F.lit(1)))))


def units_of(text: Column) -> Column:
    """The text's units. Most runs are short and ASCII and are units as they are; only others are looked at by character."""
    def cut(run: Column) -> Column:
        plain = (F.length(run) <= UNIT) & ((F.octet_length(run) == F.length(run)) | ~F.rlike(run, F.lit(f"[{UNSPACED}]")))
        return F.when(plain, F.array(run)).otherwise(F.regexp_extract_all(run, F.lit(UNITS), F.lit(1)))

    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([^{ASCII_SPACE}]+)"), F.lit(1))
    return F.flatten(F.transform(runs, cut))


def selected(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The selected (hash, position) pairs, in the order of their positions."""
    hashes = F.transform(units_of(text), lambda u: F.xxhash64(u))
    grams = _whole(_windows(hashes, k, lambda x, y: F.when(y.isNull(), x).otherwise(F.xxhash64(x, y))), k)

    # the least (hash, -position) is the rightmost least hash
    placed = F.transform(grams, lambda h, i: F.struct(h.alias("hash"), (-i).alias("back")))
    least = _whole(_windows(placed, window, lambda x, y: F.least(x, y)), window)
    # positions rise along the windows, so what is selected again follows itself
    new = lambda least: F.filter(least, lambda v, i: (i == 0) | (F.get(least, i - 1)["back"] != v["back"]))
    return F.transform(_let(least, new), lambda v: F.struct(v["hash"].alias("hash"), (-v["back"]).alias("position")))


def hashes_of(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda v: v["hash"]))


def printed(pairs: Column) -> Column:
    """``hash@position`` with commas between: sixteen hexadecimal digits, and the position in units."""
    one = lambda v: F.concat(F.lpad(F.hex(v["hash"]), 16, "0"), F.lit("@"), v["position"].cast("string"))
    return F.array_join(F.transform(pairs, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared over all hashes of two fingerprints' hash sets."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(_let(F.size(F.array_intersect(a, b)), lambda shared: shared / (total - shared)))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, fingerprint: array of (hash, position)) of each row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", selected(F.col("text"), k, window).alias("fingerprint"))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Bounds not above the id, by binary search."""
    b, n = F.array(*[F.lit(x).cast("long") for x in bounds]), len(bounds)
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(b, at + s - 1) <= doc_id), at + s).otherwise(at))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id long, text) with the window over which the row of the next smaller id follows it, the
    largest id after the smallest: the rows in ranges of ids (``_part``), each range with a copy (``_copy``) of the rows
    that begin the range after it."""
    n = parts or shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("b")).first().b if n > 1 else []
    bounds = sorted(set(bounds or []))
    # ranges in descending order of ids; null ids after all others
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - _range_of(F.col("doc_id"), bounds)) if bounds else F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    ranged = docs.withColumn("_part", part)
    heads = sorted((r._part, r.top) for r in ranged.select("doc_id", "_part").groupBy("_part").agg(F.max("doc_id").alias("top")).collect())  # one row a range
    if not heads:
        return ranged.withColumn("_copy", F.lit(False))
    before = {p: heads[i - 1][0] for i, (p, _) in enumerate(heads)}
    target = F.create_map(*[F.lit(x) for p, q in before.items() for x in (p, q)])
    top = F.create_map(*[F.lit(x) for p, t in heads if t is not None for x in (p, t)]) if any(t is not None for _, t in heads) else None
    is_head = F.col("doc_id").isNull() if top is None else F.col("doc_id").eqNullSafe(F.get(F.array(top), 0)[F.col("_part")])
    places = F.when(is_head, F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("c")), F.struct(target[F.col("_part")].alias("p"), F.lit(True).alias("c")))).otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("c"))))
    dealt = ranged.select("doc_id", "text", F.explode(places).alias("_at")).select("doc_id", "text", F.col("_at.p").alias("_part"), F.col("_at.c").alias("_copy"))
    return dealt.repartitionById(max(n, len(bounds) + 2), F.col("_part"))


#: Rows of a range in order; the copied head of the range after it comes last.
ORDER = Window.partitionBy("_part").orderBy("_copy", F.col("doc_id").desc_nulls_last(), F.col("text"))


def edited_neighbours(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint against those of its edited text and of the next document."""
    rows = with_next(docs).withColumn("_next", F.lead("text").over(ORDER))
    rows = rows.withColumn("_fp", selected(F.col("text"), k, window)).withColumn("_hashes", hashes_of(F.col("_fp")))
    rows = rows.withColumn("_next_hashes", F.lead("_hashes").over(ORDER)).filter(~F.col("_copy"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.left("text", n - third), F.left(F.coalesce("_next", F.lit("")), third)))
    rows = rows.withColumn("_edited_fp", selected(F.col("_edited"), k, window))
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), printed(F.col("_fp")).alias("fingerprint"), printed(F.col("_edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_hashes"), hashes_of(F.col("_edited_fp"))).alias("near_edited"), likeness(F.col("_hashes"), F.col("_next_hashes")).alias("near_next"),
    )
