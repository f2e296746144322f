"""Quality rules: thresholds from mergeable quantile sketches per language and source.

Each document gets a few integer measures (in thousandths).  A measure is
put into one of a bounded number of log-linear buckets, exact below 512 and within 1/256 above;
the counts per bucket are the sketch.  Two sketches merge by adding counts, so
the sketch of a (language, source) group is summed map-side first, and those of a language and of
the whole corpus are sums of the groups'.

No cutoff is fixed.  RULES names for each measure a high level (and a low one, where low values are bad too).  With q
the quantile at that level and m the median, the fence is q + SPREAD * (q - m): it follows
each group's own distribution, its place and its width.  A text breaks a rule of counts when it has more than SLACK occurrences beyond the fence,
for its size: where a count is mostly 0 its quantiles are 0, and without that a single exclamation mark would be too many.  A group's quantiles are
(n * own + PRIOR * its language's) / (n + PRIOR), those of a language the same with the corpus's, n being the group's
documents: small groups lean on larger ones, by a weight that falls smoothly.
Documents are then joined with their group's fences; what lies beyond a fence goes.

Only DataFrame functions are used.

Cases: null text counts as empty (no words: base_failed); null lang or source
is a group of its own; a group of which all documents fail the base rules has no fences and needs none; repeated rows each count; an
empty table gives an empty result; very long texts are handled in linear space and n log n time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisand.llm.shared import looked_up, row_key, staged, words

#: Measure -> levels of its lower and upper quantile in hundredths (None: no fence on that side).  The lower the level, the more
#: freely the measure is judged by the bulk of the group: symbols and odd word lengths mark junk even where a tenth of a source is junk,
#: repeated lines, repeated words, capitals and exclamations are the manner of some good texts.
RULES: dict[str, tuple[int | None, int]] = {"word_len": (25, 75), "symbols": (None, 90), "dup_lines": (None, 98), "repeats": (None, 98), "shouting": (None, 98), "marks": (None, 98)}
#: Distances between median and quantile from the quantile to the fence: for levels below 90, and from there on.
SPREAD = (8, 2)
#: Measure -> what its counts are divided by, and occurrences beyond the fence that don't break it yet (two; of repeated words, two windows found twice).
SLACK: dict[str, tuple[str, int]] = {"symbols": ("n_words", 2), "dup_lines": ("n_lines", 2), "repeats": ("n_words", 12), "shouting": ("word_chars", 2), "marks": ("n_words", 2)}
#: Documents' worth of the larger group's quantiles in a group's own.
PRIOR = 20
#: Most groups whose fences are broadcast.
GROUPS = 100_000
#: Leading bits that name a bucket.
BITS = 9
SHIFT = 28
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column, n: Column) -> dict[str, Column]:
    """Steps, to be added one by one, that count the words covered by 3-word windows found twice or more.

    Windows are first sorted by 36 hash bits with the position below them; only
    those with an equal neighbour are then compared as text, so the count is exact."""
    at = lambda a, i: F.get(a, i)
    low = (1 << SHIFT) - 1
    packed, cand, same, spots = (F.col(x) for x in ("_packed", "_cand", "_same", "_spots"))
    near = lambda x, i: F.coalesce(F.shiftright(x, SHIFT) == F.shiftright(at(packed, i - 1), SHIFT), F.lit(False)) | F.coalesce(F.shiftright(x, SHIFT) == F.shiftright(at(packed, i + 1), SHIFT), F.lit(False))
    return {
        "_packed": F.sort_array(
            F.transform(
                F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, at(w, i + 1), at(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
            )
        ),
        "_cand": F.filter(packed, near),
        "_same": F.sort_array(
            F.transform(
                cand,
                lambda x: F.struct(
                    F.concat_ws(" ", F.slice(w, x.bitwiseAND(F.lit(low)).cast("int") + 1, 3)).alias("window"),
                    x.bitwiseAND(F.lit(low)).cast("int").alias("pos"),
                ),
            )
        ),
        "_spots": F.sort_array(
            F.transform(
                F.filter(
                    same,
                    lambda x, i: F.coalesce(x["window"] == at(same, i - 1)["window"], F.lit(False))
                    | F.coalesce(x["window"] == at(same, i + 1)["window"], F.lit(False)),
                ),
                lambda x: x["pos"],
            )
        ),
        "n_repeat_words": F.aggregate(
            F.transform(spots, lambda p, i: F.least(F.lit(3), F.coalesce(at(spots, i + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (see row_key), lang, source, the five counts and the measures of every row."""
    body = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.regexp_replace(body, f"[^{chars}]+", "")).cast("long")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    df = docs.select(
        "doc_id", "lang", "source", *row_key("doc_id", "text", "lang", "source"),
        words(F.col("text")).alias("_w"),
        F.length(F.regexp_replace(body, r"[ \x09-\x0D]+", "")).cast("long").alias("word_chars"),
        without(r"#*$%&|<>").alias("n_symbols"),
        without("A-Z").alias("_upper"),
        without("!?").alias("_marks"),
        lines.alias("_lines"),
    )
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "_n_lines": F.size("_lines").cast("long")})
    df = df.withColumn("n_dup_lines", F.col("_n_lines") - F.size(F.array_distinct("_lines")))
    for name, c in _repeat_words(F.col("_w"), F.size("_w")).items():
        df = df.withColumn(name, c)
    share = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)")
    return df.select(
        "doc_id", "k1", "k2", "lang", "source", *COUNTS, F.col("_n_lines").alias("n_lines"),
        share("word_chars", "n_words").alias("word_len"),
        share("n_symbols", "n_words").alias("symbols"),
        share("n_dup_lines", "_n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("_upper", "word_chars").alias("shouting"),
        share("_marks", "n_words").alias("marks"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def bucket(v: Column) -> Column:
    """The value's log-linear bucket, named by its lowest value: itself below 512, else its nine leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: one bounded histogram per group and measure.
    Rows that fail the base rules, which go in any case, stay out of it."""
    names = ", ".join(f"'{m}', {m}" for m in RULES)
    return (
        measures.filter(~F.col("base_failed"))
        .select("lang", "source", F.expr(f"stack({len(RULES)}, {names}) as (measure, v)"))
        .groupBy("lang", "source", "measure", bucket(F.col("v")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """The sum of sketches over the groups that share these columns."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def spread(level: int) -> int:
    return SPREAD[0] if 10 < level < 90 else SPREAD[1]


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, measure, n, lo, mid and hi: the size of each group, and the quantiles of each measure."""
    from pyspark.sql import Window

    group = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    df = sketch.withColumns({"_upto": upto, "_all": F.sum("n").over(group)})
    level = lambda side: F.create_map(*[F.lit(x) for m, levels in RULES.items() for x in (m, levels[side] or 0)])[F.col("measure")]
    at = lambda q: F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * q, F.col("bucket")))
    return df.groupBy(*by, "measure").agg(F.sum("n").alias("n"), at(level(0)).alias("lo"), at(F.lit(50)).alias("mid"), at(level(1)).alias("hi"))


def leaning(own: DataFrame, larger: DataFrame, on: list[str]) -> DataFrame:
    """Quantiles of own groups, leaning on those of the larger groups they belong to."""
    more = larger.select(*on, *[F.col(q).alias(f"_{q}") for q in ("lo", "mid", "hi")])
    mixed = {q: F.expr(f"(n * {q} + {PRIOR} * _{q}) div (n + {PRIOR})") for q in ("lo", "mid", "hi")}
    return own.join(more, on).withColumns(mixed).drop("_lo", "_mid", "_hi")


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, fences (measure -> lo, hi) for every group."""
    sketch = sketch.withColumns({"lang": F.struct("lang"), "source": F.struct("source")})  # a struct that holds null joins like any value
    langs = leaning(quantiles(merged(sketch, "lang"), "lang"), quantiles(merged(sketch)), ["measure"])
    groups = leaning(quantiles(sketch, "lang", "source"), langs, ["lang", "measure"])
    lo = F.coalesce(*[F.when(F.col("measure") == m, F.col("lo") - spread(levels[0]) * (F.col("mid") - F.col("lo"))) for m, levels in RULES.items() if levels[0]])
    hi = F.coalesce(*[F.when(F.col("measure") == m, F.col("hi") + spread(levels[1]) * (F.col("hi") - F.col("mid"))) for m, levels in RULES.items()])
    return groups.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct(lo.alias("lo"), hi.alias("hi"))))).alias("fences"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and broken: the measures beyond their fences."""
    return verdicts(docs).drop("k1", "k2")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    gone = staged(verdicts(docs).filter(~F.col("kept")).select("k1", "k2").distinct(), "quality-gone")
    keyed = docs.select(F.struct("*").alias("doc"), *row_key("doc_id", "text", "lang", "source"))  # whatever the columns of docs are called
    return looked_up(keyed, gone, ["k1", "k2"], "left_anti").select("doc.*")


def verdicts(docs: DataFrame) -> DataFrame:
    """What judge() returns, and k1, k2 of each row."""
    m = staged(measured(docs), "quality-measures")
    limits = staged(thresholds(staged(sketches(m), "quality-sketches")).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "fences"), "quality-fences")
    keyed = m.withColumns({"_l": F.struct("lang"), "_s": F.struct("source")})
    slack = lambda x: F.expr(f"{SLACK[x][1] * 1000} div greatest({SLACK[x][0]}, 1)") if x in SLACK else F.lit(0)
    broken = F.filter(
        F.array(*[F.when((bucket(F.col(x)) > F.col("fences")[x]["hi"] + slack(x)) | F.coalesce(bucket(F.col(x)) < F.col("fences")[x]["lo"], F.lit(False)), F.lit(x)) for x in RULES]), lambda x: x.isNotNull()
    )
    return (
        looked_up(keyed, limits, ["_l", "_s"], "left", F.col("k1"), GROUPS)
        .withColumn("broken", F.coalesce(broken, F.array().cast("array<string>")))
        .select(
            "k1", "k2", "doc_id", *COUNTS, "base_failed",
            (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken",
        )
    )
