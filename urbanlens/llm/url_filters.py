"""URL filters by Bloom filter cascades, on DataFrame functions only.

A rule is a host and a path start; it fits urls of the host and its subdomains whose path starts so, and the longest
fitting rule decides. A url's candidate keys are its host endings and path starts of the lengths that rules have. Per
verdict, a cascade of Bloom filters holds which of the corpus's candidate keys are rules: the first filter encodes the
rules, the second those other keys of the corpus that the first lets pass, the third the rules that the second lets
pass, and so on until none is left. A key's answer is the parity of the first filter that stops it. As the cascade is
built over the complete key universe, membership is exact and urls are judged without a join.

The first filter's size follows the universe: as many hashes as keys double the rules, so that about as many false
positives as rules are expected however large the corpus, and no later filter holds more. So the filters, literals in the
plan, grow with the rules alone, some dozens of bits a rule.

Results by case: a null url or one without ``://`` has an empty host and path and fits no rule; a url that no rule
fits gets the default verdict (it is in no list); rules given twice count once, and of one key both allowed and
blocked the block holds; empty tables give no rows; columns other than the id and the url are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes of the filters after the first, and bits a key for every hash (half of a filter's bits are set then).
HASHES, BITS_A_HASH, WORD = 4, 1.5, 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Labels of the host and length of the path of the rules: as many as there are different lengths."""
    labels = F.size(F.split("host", r"\."))
    return sorted((r.labels, r.chars) for r in rules.select(labels.alias("labels"), F.length("path").alias("chars")).distinct().collect())


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of the given shapes that fit, as (chars of the host ending, key), the longest last. One expression over a
    literal array, however many shapes there are."""
    labels = F.size(F.split(host, r"\."))
    literal = F.from_json(F.lit(json.dumps([{"n": n, "chars": c} for n, c in shapes])), "array<struct<n:int,chars:int>>")

    def key(s: Column) -> Column:
        ending = F.call_function("substring_index", host, F.lit("."), -s["n"])
        start = F.left(path, s["chars"])
        made = F.struct((F.length(ending) + F.length(start)).alias("chars"), F.length(ending).alias("host_chars"), F.concat(ending, start).alias("key"))
        return F.when((host != "") & (labels >= s["n"]) & (F.length(path) >= s["chars"]), made)

    return F.array_sort(F.array_compact(F.transform(literal, key)))


def _passes(key: Column, level: int, bits: int, hashes: int, words: Column) -> Column:
    """Whether all of the key's places are set; they step from one hash by another."""
    first, step = (F.xxhash64(F.lit(2 * level + i), key) for i in (0, 1))

    def held(i: Column) -> Column:
        place = F.pmod(F.xxhash64(first, step, i), F.lit(bits))
        return F.getbit(F.get(words, F.floor(place / WORD).cast("int")), (place % WORD).cast("int")) == 1

    return F.forall(F.array(*[F.lit(i) for i in range(hashes)]), held)


def _literal(words: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def _filter_of(keys: DataFrame, level: int, n: int, hashes: int) -> tuple[int, int, list[int]]:
    """The Bloom filter of the column ``key``: bits, hashes and 64-bit words. Set bits are or-ed together in the tasks."""
    bits = max(WORD, math.ceil(n * hashes * BITS_A_HASH / WORD) * WORD)
    first, step = (F.xxhash64(F.lit(2 * level + i), F.col("key")) for i in (0, 1))
    place = F.explode(F.array(*[F.pmod(F.xxhash64(first, step, F.lit(i)), F.lit(bits)) for i in range(hashes)]))
    found = keys.select(place.alias("place")).groupBy(F.floor(F.col("place") / WORD).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % WORD).cast("int"))).alias("set"))
    words = [0] * (bits // WORD)
    for r in found.collect():  # at most as many rows as the filter has words
        words[r.word] = r.set
    return bits, hashes, words


def build_cascade(listed: DataFrame, universe: DataFrame, keys: int) -> list[tuple[int, int, list[int]]]:
    """The filters, level by level, of the distinct ``listed.key`` over all of ``universe.key``, of about ``keys`` keys or
    fewer."""
    members = listed.select("key").distinct()
    n = members.count()
    if not n:
        return []
    levels = [_filter_of(members, 0, n, max(HASHES, math.ceil(math.log2(max(2, keys / n)))))]
    # the keys of the corpus that the first filter lets pass, rules or not; one aggregation, no join
    both = members.select("key", F.lit(True).alias("in_list")).unionByName(universe.filter(_stops([F.col("key")], levels)[0]).select("key", F.lit(False).alias("in_list")))
    passed = both.groupBy("key").agg(F.max("in_list").alias("in_list")).checkpoint()
    side = False  # the keys that the next filter encodes: false positives, then members, in turn
    while True:
        rest = passed.filter(F.col("in_list") == side)
        for x in _stops([F.col("key")] * len(levels), levels):
            rest = rest.filter(x)
        n = rest.count()
        if not n:
            return levels
        levels.append(_filter_of(rest, len(levels), n, HASHES))
        side = not side


def _stops(keys: list[Column], levels: list[tuple[int, int, list[int]]]) -> list[Column]:
    """Whether each level lets its key pass."""
    return [_passes(k, level, bits, hashes, _literal(words)) for k, (level, (bits, hashes, words)) in zip(keys, enumerate(levels), strict=True)]


def in_cascade(key: Column, levels: list[tuple[int, int, list[int]]]) -> Column:
    """Whether the key, one of the universe, is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for level, passes in reversed(list(enumerate(_stops([key] * len(levels), levels)))):
        answer = F.when(~passes, F.lit(level % 2 == 1)).otherwise(answer)
    return answer


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url); ``rules``: host, path, verdict."""
    rules = rules.select("host", "path", "verdict", F.concat("host", "path").alias("key"))
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    shapes = _shapes(rules)
    if not shapes:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    judged = judged.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    universe = judged.select(F.explode("_keys.key").alias("key"))
    keys = pages.count() * len(shapes)  # at least as many as there are
    blocked = build_cascade(rules.filter("verdict = 'block'"), universe, keys)
    allowed = build_cascade(rules.filter("verdict = 'allow'"), universe, keys)
    # candidate keys of one url by length; the last that is listed decides
    listed = F.filter("_keys", lambda k: in_cascade(k["key"], blocked) | in_cascade(k["key"], allowed))
    judged = judged.withColumn("rule", F.try_element_at(F.transform(listed, lambda k: k["key"]), F.lit(-1)))
    verdict = F.when(F.col("rule").isNull(), default).when(in_cascade(F.col("rule"), blocked), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
