"""Batch question answering: hour windows (A18), two-area comparison (A19), last-year trend (A20),
areas named in a question (J6), intent (Q1), hour extraction (Q2) and the answer text (Q3).

Statistics come from ONE aggregation pass over the whole incident table
(:func:`question_stats`): 24 hour counts, one count per area, (type, year)
counts. The small result is checkpointed; the hours are inlined into the
question projection as a literal array, areas are found through an index of
their names, the trend table is joined on the detected type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.functions import calendar, text, vocab
from urbanlens.session import spread


def _checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (cuts lineage; survives executor loss)."""
    from urbanlens.session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def api_frame(incidents: DataFrame) -> DataFrame:
    """Light preprocessing of the question service: modular hour."""
    return incidents.withColumn("hour_occ", calendar.hour_modular(F.col("time_occ")))


def hour_histogram(incidents: DataFrame) -> DataFrame:
    """Incidents per modular hour (at most 24 rows)."""
    return api_frame(incidents).filter(F.col("hour_occ").isNotNull()).groupBy("hour_occ").agg(
        F.count(F.lit(1)).alias("n")
    )


def area_counts(incidents: DataFrame) -> DataFrame:
    """Incidents per non-null area."""
    return incidents.filter(F.col("area_name").isNotNull()).groupBy("area_name").agg(F.count(F.lit(1)).alias("n"))


def question_stats(incidents: DataFrame) -> DataFrame:
    """All statistics the questions need, from ONE scan: counts per modular hour (kind 'h'),
    per area (kind 'a') and per (type, year) (kind 't'). Each row contributes one key of each
    kind to a single partial/final aggregation; the result is small (24 + areas + types x years)."""
    x = incidents.select(
        calendar.hour_modular(F.col("time_occ")).cast("string").alias("h"), "area_name", "crm_cd_desc", "year"
    )
    keys = F.array(
        F.struct(F.lit("h").alias("kind"), F.col("h").alias("k"), F.lit(None).cast("int").alias("y")),
        F.struct(F.lit("a").alias("kind"), F.col("area_name").alias("k"), F.lit(None).cast("int").alias("y")),
        F.struct(F.lit("t").alias("kind"), F.col("crm_cd_desc").alias("k"), F.col("year").alias("y")),
    )
    g = x.select(F.explode(keys).alias("g")).select("g.*")
    keep = (
        ((F.col("kind") == "h") & F.col("k").isNotNull())
        | ((F.col("kind") == "a") & F.col("k").isNotNull())
        | ((F.col("kind") == "t") & F.col("y").isNotNull())
    )
    return g.filter(keep).groupBy("kind", "k", "y").agg(F.count(F.lit(1)).alias("n"))


def yearly_trend(incidents: DataFrame) -> DataFrame:
    """Per incident type (and null for all types): last two observed years, counts, % change, direction.

    Types with a single observed year have no trend and are left out.
    """
    return trend_from_stats(question_stats(incidents))


def trend_from_stats(stats: DataFrame) -> DataFrame:
    """A20 from the (type, year) counts of :func:`question_stats`; the all-types series is summed from them."""
    ty = stats.filter(F.col("kind") == "t").select(F.col("k").alias("crime"), F.col("y").alias("year"), "n")
    by_type = ty.filter(F.col("crime").isNotNull())
    all_years = ty.groupBy("year").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("crime"), "year", "n")
    yc = by_type.unionByName(all_years)
    # per crime: the two largest years, in one aggregation (no window over a possibly hot type)
    # per type the (year, count) list is bounded by the number of calendar years
    last2 = yc.groupBy("crime").agg(F.slice(F.sort_array(F.collect_list(F.struct("year", "n")), False), 1, 2).alias("top2"))
    t = last2.filter(F.size("top2") > 1).select(
        "crime",
        F.col("top2")[0]["year"].alias("last_year"),
        F.col("top2")[1]["year"].alias("prev_year"),
        F.col("top2")[0]["n"].alias("last_count"),
        F.col("top2")[1]["n"].alias("prev_count"),
    )
    change = (F.col("last_count") - F.col("prev_count")) / F.col("prev_count") * 100
    return t.select(
        "*",
        F.round(change, 6).alias("change_pct"),
        F.when(change > 0, F.lit(vocab.TREND_UP)).otherwise(F.lit(vocab.TREND_DOWN)).alias("trend"),
        text.fixed(F.abs(change), 1).alias("change_text"),
    )


def question_features(questions: DataFrame) -> DataFrame:
    """Q2 + term detection: lower text, detected type, hour interval (start, end) and intent flags."""
    low = F.lower(F.col("text"))
    pat = "(?U)" + vocab.HOUR_INTERVAL_PATTERN
    has_interval = F.regexp_extract(low, pat, 0) != ""
    return questions.select(
        "question_id",
        "text",
        low.alias("low"),
        text.question_crime(F.col("text")).alias("crime"),
        has_interval.alias("has_interval"),
        F.when(has_interval, F.regexp_extract(low, pat, 2).try_cast("int")).alias("start_h"),
        F.when(has_interval, F.regexp_extract(low, pat, 3).try_cast("int")).alias("end_h"),
        low.rlike("(?U)" + vocab.COMPARE_PATTERN).alias("is_compare"),
        low.rlike("(?U)" + vocab.TREND_PATTERN).alias("is_trend"),
    )


def _hour_array(incidents: DataFrame | None = None, stats: DataFrame | None = None) -> F.Column:
    """The 24 hour counts as a literal array (index = hour)."""
    if stats is not None:
        counts = {int(r["k"]): r["n"] for r in stats.filter(F.col("kind") == "h").select("k", "n").collect()}
    else:
        counts = dict(tuple(r) for r in hour_histogram(incidents).collect())
    return F.array(*[F.lit(int(counts.get(h, 0))).cast("bigint") for h in range(24)])


def hour_window_count(qf: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incidents whose modular hour lies in [start, end], wrapping past midnight when start > end."""
    hours = _hour_array(incidents)
    s, e = F.col("start_h"), F.col("end_h")
    inside = lambda h: F.when(s <= e, (h >= s) & (h <= e)).otherwise((h >= s) | (h <= e))
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(23)), F.lit(0).cast("bigint"),
        lambda acc, h: acc + F.when(inside(h), F.element_at(hours, h + 1)).otherwise(F.lit(0).cast("bigint")),
    )
    return qf.filter(F.col("has_interval")).select("question_id", "start_h", "end_h", total.alias("n_incidents"))


def areas_found(qf: DataFrame, incidents: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Per question, the sorted areas whose lower-case name occurs in the lower-case text, with counts.

    One path for any number of areas: names are indexed by length and hash. A text's windows of the lengths that names
    have (as many lengths as the longest name has characters, at most) are hashed, and ids and hashes alone meet in an
    equi-join, in proportion to the texts' length. A hit is confirmed on the text before it counts.

    The joins are shuffled whatever the questions' files weigh: a small file may hold many texts, and a text many windows,
    so the planner's guess from the file would gather them all in the driver.
    """
    if stats is not None:
        counts = stats.filter(F.col("kind") == "a").select(F.col("k").alias("area_name"), "n")
    else:
        counts = area_counts(incidents)
    names = counts.select("area_name", "n", F.lower("area_name").alias("la"))
    names = names.select("*", F.length("la").alias("size"), F.xxhash64("la").alias("h"))
    sizes = sorted(r["size"] for r in names.select("size").distinct().collect())
    one = F.struct(F.col("area_name").alias("area"), F.col("n"))
    if not sizes:
        return qf.withColumn("found", F.array().cast(f"array<struct<area:string,n:{names.schema['n'].dataType.simpleString()}>>"))

    def windows(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("low") - size + 1)
        hashes = F.array_distinct(F.transform(starts, lambda p: F.xxhash64(F.substring(F.col("low"), p, F.lit(size)))))
        return F.when(F.length("low") >= size, F.transform(hashes, lambda h: F.struct(F.lit(size).alias("size"), h.alias("h")))).otherwise(F.array())

    asked = qf.select("question_id", "low").filter(F.col("low").isNotNull()).distinct()
    hashed = spread(asked, "question_id", "low").select("question_id", F.explode(F.flatten(F.array(*[windows(s) for s in sizes]))).alias("w")).select("question_id", "w.*")
    # ids that several rows have are told apart by their text when a hit is confirmed
    hits = hashed.join(names.hint("merge"), ["size", "h"]).select("question_id", "la", one.alias("one")).distinct()
    found = asked.join(hits.hint("merge"), "question_id").filter(F.contains("low", "la")).groupBy("question_id", "low").agg(F.sort_array(F.collect_list("one")).alias("found"))
    return qf.join(found.hint("merge"), ["question_id", "low"], "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))


def compare_areas(found: DataFrame) -> DataFrame:
    """First two areas found: counts, absolute difference, winner (tie -> the second)."""
    two = found.filter(F.size("found") >= 2).select(
        "question_id", F.col("found")[0].alias("a1"), F.col("found")[1].alias("a2")
    )
    return two.select(
        "question_id",
        F.col("a1.area").alias("area1"),
        F.col("a2.area").alias("area2"),
        F.col("a1.n").alias("count1"),
        F.col("a2.n").alias("count2"),
        F.abs(F.col("a1.n") - F.col("a2.n")).alias("diff"),
        F.when(F.col("a1.n") > F.col("a2.n"), F.col("a1.area")).otherwise(F.col("a2.area")).alias("winner"),
    )


def _trend_join(qf: DataFrame, trend: DataFrame) -> DataFrame:
    """Each question with the trend of its type, or of all types (a null key, which no type has)."""
    tt = trend.select(*[F.col(c).alias("t_" + c) for c in trend.columns])
    return qf.join(tt, F.col("crime").eqNullSafe(F.col("t_crime")), "left")


class Answerer:
    """Question answering with its statistics prepared once (one scan, checkpointed): the 24 hour
    counts become a literal array, area counts and the trend table stay tables.
    Calling it on any batch of questions is then a projection and equi-joins with those."""

    def __init__(self, incidents: DataFrame):
        stats = _checkpoint(question_stats(incidents))  # one scan of the incidents, small result
        self.stats = stats
        self.hours = _hour_array(stats=stats)
        self.trend = _checkpoint(trend_from_stats(stats))

    def __call__(self, questions: DataFrame) -> DataFrame:
        qf = question_features(questions)
        hours = self.hours
        s, e = F.col("start_h"), F.col("end_h")
        inside = lambda h: F.when(s <= e, (h >= s) & (h <= e)).otherwise((h >= s) | (h <= e))
        qf = qf.withColumn(
            "window_n",
            F.when(F.col("has_interval"), F.aggregate(
                F.sequence(F.lit(0), F.lit(23)), F.lit(0).cast("bigint"),
                lambda acc, h: acc + F.when(inside(h), F.element_at(hours, h + 1)).otherwise(F.lit(0).cast("bigint")),
            )),
        )
        qf = areas_found(qf, stats=self.stats)
        qf = _trend_join(qf, self.trend)
        return _answer(qf)


def answer_questions(questions: DataFrame, incidents: DataFrame) -> DataFrame:
    """Q1 + Q3: resolved intent and answer text for every question."""
    return Answerer(incidents)(questions)


def _answer(qf: DataFrame) -> DataFrame:
    s, e = F.col("start_h"), F.col("end_h")
    a1, a2 = F.col("found")[0], F.col("found")[1]
    n1, n2 = a1["n"], a2["n"]
    fmt = lambda c: F.format_number(c, 0)
    interval_txt = text.fill(vocab.INTERVAL_ANSWER, start=s, end=e, count=fmt(F.col("window_n")))
    compare_ok = F.col("is_compare") & (F.size("found") >= 2)
    winner = F.when(n1 > n2, a1["area"]).otherwise(a2["area"])
    compare_txt = text.fill(vocab.COMPARE_ANSWER, a1=a1["area"], c1=fmt(n1), a2=a2["area"], c2=fmt(n2), winner=winner,
                            diff=fmt(F.abs(n1 - n2)))
    trend_ok = F.col("is_trend") & F.col("t_last_year").isNotNull()
    target = F.coalesce(F.col("crime"), F.lit(vocab.ALL_CRIMES_LABEL))
    trend_txt = text.fill(vocab.TREND_ANSWER, target=target, trend=F.col("t_trend"), pct=F.col("t_change_text"))
    intent = (
        F.when(F.col("has_interval"), F.lit("hour_interval"))
        .when(compare_ok, F.lit("comparison"))
        .when(trend_ok, F.lit("trend"))
        .otherwise(F.lit("generic"))
    )
    answer = (
        F.when(F.col("has_interval"), interval_txt)
        .when(compare_ok, compare_txt)
        .when(trend_ok, trend_txt)
        .otherwise(F.lit(vocab.GENERIC_ANSWER))
    )
    return qf.select("question_id", intent.alias("intent"), answer.alias("answer"))
