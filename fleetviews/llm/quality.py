"""Quality rules with thresholds that follow the data, by DataFrame functions alone.

Each document gets counts; ratios of them go into quantile sketches per language and source: counts
of values in bins that grow by ``GROWTH``, so a quantile is right to that factor. Such sketches
merge by adding counts, in any order to the same result: partial ones combine on the map side, and
those of a language, and of all languages, are merged from the small ones. (Spark's KLL sketches
draw random bits, so a rerun could judge otherwise.)

A sketch gives an upper fence, the higher of two marks. The first is the median plus ``REACH`` times
its distance to the 0.75 quantile. The second is the sketch's change point: the bin after which two
classes, split there, differ most (the largest variance between them), if the split explains at least
``CHANGE`` of all variance. Most documents have no symbols and no line twice, so that quartiles of
those ratios are 0; there the change point decides. Where neither says anything (no distance, no
split), the sketch has no fence. For word length there is a lower fence too, by the quartile below.

Fences of small groups lean on larger ones, smoothly: a language's is the mean of its own, weighted
with its documents, and that of all, weighted as ``PRIOR`` documents; a source's leans on its
language's in the same way, and that of all on the median plus ``FIRST``, so that those constants fade as
the table grows. A group without a fence takes its parent's, all documents the largest value. A group
only widens what its parent allows: a source of clean documents isn't cut for being even, and a
source where symbols are usual keeps its own. Thresholds are joined to the counts and filter them.

The fixed part is ``base_failed`` (too few words, or too much repetition); it does not enter the
sketches. Null and empty texts have no words and fail it. Null languages and sources are groups
of their own. Rows that repeat are judged alike. An empty table gives an empty result. Columns
of other names are carried by ``accepted`` unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
REACH = 8.0
#: Part of the variance that a change point must explain: halfway from what the best split of evenly
#: spread values explains (3/4) to two separate values (1).
CHANGE = 0.875
#: Documents that the fence of the parent counts for.
PRIOR = 200
#: Distance of the fence of no documents from their median, by ratio.
FIRST = {"symbols": 0.10, "dup_lines": 0.30, "word_length": 3.0}
#: Bins of the sketches: their relative width, and the value up to which all is one bin.
GROWTH = 1.005
FINEST = 1e-6
#: Quantiles read from the sketches.
QUANTILES = {"lower": 0.25, "middle": 0.5, "upper": 0.75}
#: Ratios whose low values are judged too.
BOTH_SIDES = ("word_length",)
SYMBOLS = "#*$%&|<>"
SPLIT = "[\\x20\\x09-\\x0D]+"


def _window_hashes(words: Column) -> Column:
    """A hash for every window of eight words, in order."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def counts(docs: DataFrame, key: str) -> DataFrame:
    """key, doc_id, lang, source and the counts of every document."""
    text = F.col("text_")
    bare = F.translate(text, common.SPACES, "")
    plain = F.translate(text, SYMBOLS, "")
    rows = docs.select(
        F.col(key).alias("key"), F.col("doc_id").cast("long"), F.col("lang"), F.col("source"),
        common.text_of().alias("text_"),
    )
    rows = common.once(
        rows,
        lines=F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, common.SPACES, "")) > 0),
        words=F.filter(F.split(text, SPLIT), lambda w: w != ""),
        word_chars=F.char_length(bare).cast("long"),
        n_symbols=(F.char_length(text) - F.char_length(plain)).cast("long"),
    ).drop("text_")
    rows = common.once(
        rows,
        n_words=F.size("words").cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        hashes=_window_hashes(F.col("words")),
    ).drop("lines", "words")
    # Where all hashes differ, nothing repeats. Else windows sorted by hash stand beside their equals,
    # and the words they cover are counted from start to start.
    by_hash = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = common.once(
        rows, pairs=F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), by_hash)
    ).drop("hashes")
    pairs, n = F.col("pairs"), F.size("pairs")
    same = F.zip_with(
        F.slice(pairs, F.lit(1), n - 1), F.slice(pairs, F.lit(2), n - 1), lambda a, b: a["h"] == b["h"]
    )
    rows = common.once(rows, same=F.when(pairs.isNotNull(), same))
    no = F.array(F.lit(False))
    beside = F.arrays_zip(
        pairs.alias("p"), F.concat(no, F.col("same")).alias("before"), F.concat(F.col("same"), no).alias("after")
    )
    hit = F.filter(beside, lambda z: z["before"] | z["after"])
    rows = common.once(rows, places=F.when(pairs.isNotNull(), F.sort_array(F.transform(hit, lambda z: z["p"]["i"]))))
    places, m = F.col("places"), F.size("places")
    steps = F.zip_with(
        F.slice(places, F.lit(1), m - 1), F.slice(places, F.lit(2), m - 1),
        lambda a, b: F.least(b - a, F.lit(WINDOW)),
    )
    covered = F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)
    return rows.select(
        "key", "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.size("places") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def _ratios() -> dict[str, Column]:
    return {
        "symbols": F.try_divide("n_symbols", "word_chars"),
        "dup_lines": F.try_divide("n_dup_lines", "n_lines"),
        "word_length": F.try_divide("word_chars", "n_words"),
    }


def _fences(bins: DataFrame, *by: str) -> DataFrame:
    """Per group and ratio: documents, median, end values, and the fences (NULL where there is none)."""
    group = Window.partitionBy(*by, "ratio")
    upto = group.orderBy("bin")
    whole = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.when(F.col("bin") == 0, 0.0).otherwise(FINEST * F.pow(F.lit(GROWTH), F.col("bin") - 1))
    ranked = (
        bins.groupBy(*by, "ratio", "bin").agg(F.sum("n").alias("n"))
        .withColumn("value", value)
        .withColumn("below", F.sum("n").over(upto))
        .withColumn("mass", F.sum(F.col("n") * F.col("value")).over(upto))
        .withColumn("total", F.sum("n").over(group))
        .withColumn("all_mass", F.last("mass").over(whole))
        .withColumn("squares", F.sum(F.col("n") * F.col("value") * F.col("value")).over(whole))
    )
    above = F.col("total") - F.col("below")
    apart = F.try_divide(F.col("mass"), F.col("below")) - F.try_divide(F.col("all_mass") - F.col("mass"), above)
    between = F.when(above > 0, F.col("below") * above * apart * apart / F.col("total"))
    marks = ranked.groupBy(*by, "ratio").agg(
        F.max("total").alias("total"),
        F.min("value").alias("bottom"),
        F.max("value").alias("top"),
        F.max(F.struct(between.alias("between"), F.col("value"))).alias("split"),
        F.max(F.col("squares") - F.col("all_mass") * F.col("all_mass") / F.col("total")).alias("variance"),
        *[F.min(F.when(F.col("below") >= p * F.col("total"), F.col("value"))).alias(q) for q, p in QUANTILES.items()],
    )
    change = F.when(F.col("split.between") >= CHANGE * F.col("variance"), F.col("split.value"))
    rise, fall = F.col("upper") - F.col("middle"), F.col("middle") - F.col("lower")
    return marks.select(
        *by, "ratio", "total", "middle", "bottom", "top",
        F.greatest(F.when(rise > 0, F.col("middle") + REACH * rise), change).alias("high"),
        F.when(fall > 0, F.col("middle") - REACH * fall).alias("low"),
    )


def _leaning(own: Column, total: Column, parent: Column) -> Column:
    """The mean of a group's fence and its parent's; the parent's where the group has none."""
    return F.coalesce((total * own + PRIOR * parent) / (total + PRIOR), parent)


def thresholds(judged: DataFrame) -> DataFrame:
    """lang_, source_ and the bounds of every ratio, from the counts of ``judged``."""
    ratios = F.explode(F.map_from_arrays(
        F.array(*[F.lit(name) for name in _ratios()]), F.array(*_ratios().values())
    )).alias("ratio", "value")
    bin_ = F.when(F.col("value") <= FINEST, 0).otherwise(
        1 + F.ceil(F.log(F.col("value") / FINEST) / math.log(GROWTH))
    )
    bins = common.saved(
        judged.select("lang", "source", ratios)
        .groupBy("lang", "source", "ratio", bin_.cast("long").alias("bin")).agg(F.count("*").alias("n")),
        "sketches",
    )
    first = F.element_at(F.create_map(*[F.lit(x) for pair in FIRST.items() for x in pair]), F.col("ratio"))
    every = _fences(bins).select(
        F.col("ratio").alias("ratio_"),
        _leaning(F.coalesce("high", "top"), F.col("total"), F.col("middle") + first).alias("most_"),
        _leaning(F.coalesce("low", "bottom"), F.col("total"), F.col("middle") - first).alias("least_"),
    )

    def widened(groups: DataFrame, parents: DataFrame, match: Column) -> DataFrame:
        most = F.greatest(F.col("most_"), _leaning(F.col("high"), F.col("total"), F.col("most_")))
        least = F.least(F.col("least_"), _leaning(F.col("low"), F.col("total"), F.col("least_")))
        kept = [c for c in ("lang", "source", "ratio") if c in groups.columns]
        return groups.join(parents, match).select(*kept, most.alias("most"), least.alias("least"))

    same = F.col("ratio") == F.col("ratio_")
    languages = widened(_fences(bins, "lang"), every, same).toDF("lang_", "ratio_", "most_", "least_")
    own = widened(_fences(bins, "lang", "source"), languages, same & F.col("lang").eqNullSafe(F.col("lang_")))
    bounds = [F.max(F.when(F.col("ratio") == name, F.col("most"))).alias(f"most_{name}") for name in FIRST]
    bounds += [F.max(F.when(F.col("ratio") == name, F.col("least"))).alias(f"least_{name}") for name in BOTH_SIDES]
    return own.groupBy("lang", "source").agg(*bounds).withColumnsRenamed({"lang": "lang_", "source": "source_"})


def verdicts(docs: DataFrame, key: str) -> DataFrame:
    """key, doc_id, the counts, ``base_failed`` and ``kept`` of every document."""
    rows = common.saved(counts(docs, key), "counts").withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    ratios = _ratios()
    limits = thresholds(rows.filter("NOT base_failed"))
    fits = F.lit(True)
    for name, ratio in ratios.items():
        fits = fits & (ratio <= F.col(f"most_{name}"))
        if name in BOTH_SIDES:
            fits = fits & (ratio >= F.col(f"least_{name}"))
    matched = rows.join(
        limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left"
    )
    return matched.select(*rows.columns, (~F.col("base_failed") & F.coalesce(fits, F.lit(True))).alias("kept"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    rows, key = common.keyed(docs)
    rejected = verdicts(rows, key).filter("NOT kept").select(F.col("key").alias(key))
    return rows.join(common.saved(rejected, "rejected"), key, "left_anti").select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = common.keyed(common.documents(spark, sf_dir))
    return verdicts(docs, key).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
