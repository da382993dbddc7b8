"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per document, text statistics are taken once and written to the shared folder. Mergeable KLL sketches of
the rule metrics, of all values and of those above zero, are built per (lang, source) and merged over each
language and over everything. No constant of a metric's own unit decides a fence:

- ``spread``: median +- ``spread`` times the distance of the outer quartile, where that distance is above zero;
- else (the metric is zero in most documents) the values above zero decide. ``apart``: if their lower tenth
  lies further from zero than ``1 / apart`` of the distance to their upper tenth, they are a population of their
  own and the fence is half that lower tenth; ``nonzero``: else their median + ``spread`` times the distance of
  their outer quartile;
- ``none``: without values above zero there is nothing to judge, and no fence.

Each fence comes from the narrowest level (group, lang, all) that has ``min_rows`` rows and, where the values
above zero decide, half as many of them; else from everything. The fences are joined back and filter the documents.

Defined results: null text counts as empty; empty texts have zero statistics and fail the base rule;
null lang or source form groups of their own; repeated rows are judged alike; columns of the input that
are not asked for by ``keep`` are ignored, so clashing names do no harm; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, words_of

# Characters that count as symbols, and as marks of shouting.
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
#: Up to so many distinct repeated windows are looked up by scanning their list.
FEW_WINDOWS = 48


@dataclass(frozen=True)
class Metric:
    """A ratio that is judged, and the sides that have a fence."""

    name: str
    low: bool = False
    high: bool = True


METRICS = (
    Metric("symbol_ratio"),
    Metric("mean_word_chars", low=True),
    Metric("dup_line_ratio"),
    Metric("repeat_ratio"),
    Metric("upper_ratio"),
    Metric("shout_ratio"),
)
LEVELS = ("group", "lang", "all")


def _repeat_words(words: Column) -> Column:
    """Words lying in 3-word windows found at least twice in the text.

    Windows are hashed to 64 bits and the hashes sorted, so equal windows are neighbours and give the set
    of repeated ones. Positions of a few repeated windows are looked up directly; of many, by sorting
    (hash, position) pairs. The union of [p, p + 3) over these positions is measured. All state is arrays
    of one document.
    """

    def windows(w: Column) -> Column:
        cut = F.greatest(F.size(w) - 2, F.lit(0))
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        pairs = F.transform(F.array(hashed), lambda h: F.zip_with(F.zip_with(F.slice(h, F.lit(1), cut), F.slice(h, F.lit(2), cut), lambda a, b: F.xxhash64(a, b)), F.slice(h, F.lit(3), cut), lambda ab, c: F.xxhash64(ab, c)))
        return pairs[0]

    def repeated(h: Column) -> Column:
        def neighbours(s: Column) -> Column:
            n = F.greatest(F.size(s) - 1, F.lit(0))
            return F.array_distinct(F.array_compact(F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(a == b, a))))

        return F.transform(F.array(F.sort_array(h)), neighbours)[0]

    def by_lookup(h: Column, d: Column) -> Column:
        return F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)))

    def by_sorting(h: Column) -> Column:
        def twins(s: Column) -> Column:
            n = F.greatest(F.size(s) - 1, F.lit(0))
            pairs = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
            return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

        return F.transform(F.array(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))), twins)[0]

    def union(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def measured(h: Column, d: Column) -> Column:
        return F.when(F.size(d) == 0, F.lit(0)).otherwise(union(F.when(F.size(d) <= FEW_WINDOWS, by_lookup(h, d)).otherwise(by_sorting(h))))

    # One-element arrays bind a value to a lambda variable, so that it is evaluated once.
    bound = F.transform(F.array(windows(words)), lambda h: F.transform(F.array(repeated(h)), lambda d: measured(h, d))[0])
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bound[0])


def text_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and the statistics of each whole text."""
    split = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counted(chars: str) -> Column:
        return (F.size(F.split("__t", f"[{chars}]")) - 1).cast("long")

    counts = split.select(
        *keep,
        F.transform(F.array(words_of(F.col("__t"))), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeat_words(w).alias("r")))[0].alias("__w"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))[0].alias("__l"),
        counted(SYMBOLS).alias("n_symbols"),
        counted("A-Z").alias("n_upper"),
        counted(SHOUTS).alias("n_shouts"),
    )
    return counts.select(
        *keep,
        F.col("__w.n").cast("long").alias("n_words"),
        F.col("__w.c").cast("long").alias("word_chars"),
        "n_symbols",
        F.col("__l.d").cast("long").alias("n_dup_lines"),
        F.col("__w.r").cast("long").alias("n_repeat_words"),
        F.col("__l.n").cast("long").alias("n_lines"),
        "n_upper",
        "n_shouts",
    )


def _metrics() -> list[Column]:
    def per(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))

    return [
        per("n_symbols", "word_chars").alias("symbol_ratio"),
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("n_upper", "word_chars").alias("upper_ratio"),
        per("n_shouts", "word_chars").alias("shout_ratio"),
    ]


def _fence(m: Metric, side: str, spread: float, apart: float) -> Column:
    """(rule, at) of one metric's fence on one side, out of its sketches. Rounded, so that sketch noise moves no verdict by an ulp."""

    def of(sketch: str, *ranks: float) -> list[Column]:
        return [F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(r)) for r in ranks]

    def ruled(rule: str, at: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.round(at, 4).alias("at"))

    all_, above = m.name, f"{m.name}_above"
    middle, outer = of(all_, 0.5, 0.25 if side == "low" else 0.75)
    chosen = F.when(middle != outer, ruled("spread", middle + spread * (outer - middle)))
    if side == "high":
        tenth, half, quarter, ninth = of(above, 0.1, 0.5, 0.75, 0.9)
        some = F.col(f"{m.name}_n") > 0
        chosen = chosen.when(some & (apart * tenth > ninth - tenth), ruled("apart", tenth / 2)).when(some, ruled("nonzero", half + spread * (quarter - half)))
    return chosen.otherwise(ruled("none", F.lit(None).cast("double")))


def fence_columns() -> list[str]:
    return [f"{m.name}_{side}" for m in METRICS for side in ("low", "high") if getattr(m, side)]


def adaptive_fences(stats: DataFrame, scratch: Scratch, min_rows: int = 200, spread: float = 10.0, apart: float = 4.0, k: int = 400) -> DataFrame:
    """One row per (lang, source): for each fence a struct of rule, at and level.

    Rows that fail the base rule (``base_failed``) do not shape the fences.
    """
    judged = stats.where(~F.col("base_failed")).select("lang", "source", *_metrics())
    pairs = [c for m in METRICS for c in (m.name, f"{m.name}_above")]
    sketched = [F.count(F.lit(1)).alias("n")]
    for m in METRICS:
        above = F.when(F.col(m.name) > 0, F.col(m.name))
        sketched += [F.kll_sketch_agg_double(m.name, F.lit(k)).alias(m.name), F.kll_sketch_agg_double(above, F.lit(k)).alias(f"{m.name}_above"), F.count(above).alias(f"{m.name}_n")]
    sketches = scratch.save(judged.groupBy("lang", "source").agg(*sketched), "sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, F.lit(k)).alias(c) for c in pairs], *[F.sum(f"{m.name}_n").alias(f"{m.name}_n") for m in METRICS]]
    sides = [(m, side) for m in METRICS for side in ("low", "high") if getattr(m, side)]

    def fenced(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
        columns = []
        for m, side in sides:
            f = _fence(m, side, spread, apart)
            columns.append(F.struct(f["rule"].alias("rule"), f["at"].alias("at"), F.lit(level).alias("level"), F.col("n"), F.col(f"{m.name}_n").alias("above")).alias(f"{level}_{m.name}_{side}"))
        return df.select(*[F.col(c).alias(f"{level}_{c}") for c in keys], *columns)

    own = fenced(sketches, ["lang", "source"], "group")
    by_lang = fenced(sketches.groupBy("lang").agg(*merged), ["lang"], "lang")
    overall = fenced(sketches.groupBy(F.lit(1).alias("one")).agg(*merged), ["one"], "all")
    joined = own.join(by_lang, own["group_lang"].eqNullSafe(by_lang["lang_lang"]), "left").join(overall, F.lit(1) == overall["all_one"], "left")

    def chosen(name: str) -> Column:
        at = [F.col(f"{level}_{name}") for level in LEVELS]
        fits = [(x["n"] >= min_rows) & ((x["rule"] == "spread") | (2 * x["above"] >= min_rows)) for x in at]
        best = F.when(fits[0], at[0]).when(fits[1], at[1]).otherwise(at[2])
        return F.struct(best["rule"].alias("rule"), best["at"].alias("at"), best["level"].alias("level")).alias(name)

    return joined.select(F.col("group_lang").alias("lang"), F.col("group_source").alias("source"), *[chosen(c) for c in fence_columns()])


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, min_rows: int = 200, spread: float = 10.0) -> DataFrame:
    """Statistics, base verdict, adaptive verdict and the metrics outside their fences, per document."""
    scratch = Scratch(docs.sparkSession, "rules")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    stats = scratch.save(text_statistics(docs).withColumn("base_failed", failed), "stats")
    fences = scratch.save(adaptive_fences(stats, scratch, min_rows, spread), "fences")
    s = stats.select("*", *_metrics())
    f = fences.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = s.join(f, s["lang"].eqNullSafe(f["f_lang"]) & s["source"].eqNullSafe(f["f_source"]), "left")
    outside = []
    for m in METRICS:
        bad = F.lit(False)
        if m.low:
            bad = bad | F.coalesce(F.col(m.name) < F.col(f"{m.name}_low.at"), F.lit(False))
        if m.high:
            bad = bad | F.coalesce(F.col(m.name) > F.col(f"{m.name}_high.at"), F.lit(False))
        outside.append(F.when(bad, F.lit(m.name)))
    used = [F.concat_ws(":", F.lit(c), F.col(f"{c}.rule"), F.col(f"{c}.level")) for c in fence_columns()]
    out = joined.withColumn("failed_rules", F.array_compact(F.array(*outside)))
    return out.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        "failed_rules",
        F.concat_ws(",", *used).alias("fences"),
    )
