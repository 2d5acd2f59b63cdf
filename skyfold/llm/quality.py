"""Quality rules whose thresholds follow each language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import SPACE_CHARS, broadcast_if_small, frozen, let, packed, text_of, unpacked, words_of

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Number of threshold rows (one for each language and source) up to which they are broadcast: some 8 MB.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class QualityRules:
    """Limits of the base rules, and how far from a group's quartiles a document may lie.

    ``fence`` quartile distances beyond the quartiles are allowed. The distance
    counts as ``least_*`` at least, so that a group of equal documents does not
    refuse everything else. Groups of fewer than ``least_docs`` documents use
    their language's sketch, or that of all documents.
    """

    least_words: int = 20
    repeat_percent: int = 30
    fence: int = 4
    least_symbols: int = 20
    least_length: int = 20
    least_lines: int = 100
    least_docs: int = 50


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _covered(words: Column, run: int) -> Column:
    """Words inside runs that occur twice or more: equal runs stand side by side after a sort."""
    at = F.sequence(F.lit(1), F.size(words) - (run - 1))
    runs = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(run)), " ").alias("t"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["t"] == x["t"], F.lit(False))
        return F.array_sort(F.filter(F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()))

    def union(p: Column) -> Column:
        return _sum(F.transform(p, lambda i, k: F.coalesce(F.least(F.lit(run), F.get(p, k + 1) - i), F.lit(run)).cast("long")))

    return let(runs, lambda s: let(starts(s), union))


def repeated_words(words: Column, run: int = 8) -> Column:
    """Number of words inside runs of ``run`` words found twice or more. Texts whose run hashes all differ need no sort."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (run - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(run))))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(words, run)))
    return F.when(F.size(words) < run, F.lit(0).cast("long")).otherwise(found)


def without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def signals(text: Column) -> dict[str, Column]:
    """The counts of one text as expressions."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    line_counts = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dups")))
    return {
        "word_counts": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeats"))),
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": without(text, SPACE_CHARS).cast("long"),
        "n_symbols": (F.char_length(text) - without(text, SYMBOLS)).cast("long"),
        "line_counts": line_counts,
    }


def _rates(df: DataFrame) -> DataFrame:
    """Symbols per 1,000 characters, 100ths of a word's mean length, repeated lines per 1,000."""
    rate = lambda a, b, by: F.expr(f"{by} * {a} div greatest({b}, 1)")
    return df.withColumns({"_symbols": rate("_n_symbols", "_word_chars", 1000), "_length": rate("_word_chars", "_n_words", 100), "_repeats": rate("_line_counts.dups", "_line_counts.lines", 1000)})


def _bin(value: Column) -> Column:
    """Three significant digits: a quantile is off by 1 % at most, and bins of any two sketches agree."""
    step = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("long")
    return value - value % step


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each signal from the bins of a sketch, one row for each key."""
    group = Window.partitionBy(*keys, "_signal")
    counts = sketch.groupBy(*keys, "_signal", "_bin").agg(F.sum("_n").alias("_n"))
    ranked = counts.withColumns({"_below": F.sum("_n").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(group)})
    out = [F.max("_all").alias("_docs")]
    for k, name in enumerate(("symbols", "length", "repeats")):
        for q in (1, 3):
            out.append(F.min(F.when((F.col("_signal") == k) & (4 * F.col("_below") >= q * F.col("_all")), F.col("_bin"))).alias(f"{name}_q{q}"))
    return ranked.groupBy(*keys).agg(*out)


def thresholds(rated: DataFrame, rules: QualityRules) -> DataFrame:
    """One row for each language and source: allowed ranges from merged sketches.

    A sketch is a count per bin. Sketches add up, so partial ones of every task
    merge into a group's, the groups' into a language's, and those into that of
    all documents; a hot source is counted in every task that reads it. The
    result does not depend on the order of merging.
    """
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), _bin(F.col(c)).alias("b")) for k, c in enumerate(("_symbols", "_length", "_repeats"))]))
    exploded = rated.where(F.col("_n_words") >= rules.least_words).select("_lang", "_source", bins.alias("_x"))
    sketch = frozen(exploded.groupBy("_lang", "_source", F.col("_x.s").alias("_signal"), F.col("_x.b").alias("_bin")).agg(F.count("*").alias("_n")))
    names = [f"{n}_q{q}" for n in ("symbols", "length", "repeats") for q in (1, 3)]
    whole = _quartiles(sketch.withColumn("_one", F.lit(1)), ["_one"]).first()
    own = _quartiles(sketch, ["_lang", "_source"])
    wider = _quartiles(sketch, ["_lang"]).select(F.col("_lang").alias("_wl"), F.col("_docs").alias("_wd"), *[F.col(n).alias(f"_w{n}") for n in names])
    both = own.join(wider, F.col("_lang").eqNullSafe(F.col("_wl")), "left")
    pick = lambda n: F.when(F.col("_docs") >= rules.least_docs, F.col(n)).when(F.col("_wd") >= rules.least_docs, F.col(f"_w{n}")).otherwise(F.lit(whole[n] if whole else None).cast("long"))
    q = both.select("_lang", "_source", *[pick(n).alias(n) for n in names])
    reach = lambda n, least: rules.fence * F.greatest(F.col(f"{n}_q3") - F.col(f"{n}_q1"), F.lit(least))
    return frozen(
        q.select(
            F.col("_lang").alias("_tl"), F.col("_source").alias("_ts"),
            (F.col("symbols_q3") + reach("symbols", rules.least_symbols)).alias("max_symbols"),
            (F.col("length_q1") - reach("length", rules.least_length)).alias("min_length"),
            (F.col("length_q3") + reach("length", rules.least_length)).alias("max_length"),
            (F.col("repeats_q3") + reach("repeats", rules.least_lines)).alias("max_lines"),
        )
    )


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """All rows of docs with the counts, ``base_failed`` and ``kept``.

    The first pass needs only the cheap counts and leaves sketches; the second
    joins each row with its group's thresholds. Those are one row for each
    language and source: broadcast when a count proves them few, else joined by
    key. NULL languages and sources are groups like any other. NULL and empty
    texts have no words, so they fail the base rules. A table without any
    document of enough words, an empty one included, has no thresholds and keeps
    nothing. Repeated rows get equal verdicts.
    """
    text = text_of(F.col(f"_row.`{text_col}`"))
    rows = packed(docs).withColumns({f"_{k}": v for k, v in signals(text).items()})
    rated = _rates(rows.withColumns({"_lang": F.col(f"_row.`{lang_col}`").cast("string"), "_source": F.col(f"_row.`{source_col}`").cast("string")}))
    limits = broadcast_if_small(thresholds(rated, rules), BROADCAST_ROWS)
    n, repeats = F.col("_word_counts.n"), F.col("_word_counts.repeats")
    met = rated.join(limits, F.col("_lang").eqNullSafe(F.col("_tl")) & F.col("_source").eqNullSafe(F.col("_ts")), "left")
    failed = (n < rules.least_words) | (100 * repeats > rules.repeat_percent * n)
    inside = (F.col("_symbols") <= F.col("max_symbols")) & F.col("_length").between(F.col("min_length"), F.col("max_length")) & (F.col("_repeats") <= F.col("max_lines"))
    return unpacked(met, {
        "n_words": n, "word_chars": F.col("_word_chars"), "n_symbols": F.col("_n_symbols"), "n_dup_lines": F.col("_line_counts.dups"), "n_repeat_words": repeats,
        "base_failed": failed, "kept": ~failed & F.coalesce(inside, F.lit(False)),
    })
