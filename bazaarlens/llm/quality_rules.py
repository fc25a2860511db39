"""Quality rules whose cut-offs come from the data: a fence per language and source, from mergeable quantile sketches.

Every document gets its measures (shares of symbols, capitals, repeated words and lines, mean word length). A KLL
sketch per (lang, source) holds the distribution of each measure; sketches of small groups are merged up to the
language, and to all documents. A document goes if a measure lies beyond the fence of its group: the median plus
`REACH` times the distance of the quartiles, which a quarter of bad documents in a group doesn't move. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import free_name, saved

#: Java pattern of the characters between words.
GAP = "[\\x20\\x09-\\x0D]+"
#: Measure: least distance of quartiles that a fence counts with, and whether low values are bad as well.
MEASURES = {
    "symbols_per_word": (0.03, False),
    "capital_share": (0.04, False),
    "repeat_share": (0.07, False),
    "dup_line_share": (0.1, False),
    "mean_word_chars": (0.6, True),
}
REACH = 5.0
#: Groups with fewer documents take the fences of their language, and languages with fewer those of all documents.
LEAST_DOCS = 200
#: Size parameter of the sketches: rank errors under half a per cent.
SKETCH_K = 800

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the struct `rules` of counts, shares and the base verdict; null texts have no words.

    Words in repeated three-word windows: windows are sorted as numbers (hash and place in one), neighbours with the
    same hash are compared as words, and places of windows that occur again are merged into words covered.
    """
    own = free_name(docs, "rules_")
    kept = [docs[c] for c in docs.columns]
    text = F.coalesce(docs[text_col], F.lit(""))
    f = docs.select(*kept, F.struct(text.alias("t"), F.btrim(text, F.lit(" \t\n\x0b\f\r")).alias("core")).alias(own))

    def step(frame: DataFrame, **new: str) -> DataFrame:
        # Fields of the one struct column, so that no name of the documents' columns is touched.
        fields = [f"{e.replace('@', own + '.')} AS {n}" for n, e in new.items()]
        return frame.withColumn(own, F.expr(f"struct({own}.*, {', '.join(fields)})"))

    f = step(f, w=f"IF(@core = '', CAST(array() AS array<string>), split(@core, '{GAP}'))".replace("\\", "\\\\"))
    f = step(f, n="size(@w)", bits="length(bin(size(@w)))")
    # slice() is empty where there are fewer than three words
    f = step(
        f,
        s="sort_array(transform(slice(@w, 1, greatest(@n - 2, 0)), (a, i) -> "
        "shiftleft(xxhash64(a, get(@w, i + 1), get(@w, i + 2)), @bits) | CAST(i AS BIGINT)))",
    )
    f = step(
        f,
        p="transform(filter(@s, (x, i) -> coalesce(shiftright(x, @bits) = shiftright(get(@s, i - 1), @bits), false) OR "
        "coalesce(shiftright(x, @bits) = shiftright(get(@s, i + 1), @bits), false)), "
        "x -> CAST(x & (shiftleft(1L, @bits) - 1) AS INT))",
    )
    f = step(
        f,
        e="sort_array(transform(@p, i -> struct(get(@w, i) AS a, get(@w, i + 1) AS b, get(@w, i + 2) AS c, i AS i)))",
    )
    same = "(x.a = get(@e, {0}).a AND x.b = get(@e, {0}).b AND x.c = get(@e, {0}).c)"
    f = step(
        f,
        q="sort_array(transform(filter(@e, (x, k) -> coalesce("
        + same.format("k - 1")
        + ", false) OR coalesce("
        + same.format("k + 1")
        + ", false)), x -> x.i))",
        lines="filter(split(@t, '\\\\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')",
    )
    f = step(
        f,
        n_words="CAST(@n AS BIGINT)",
        word_chars="CAST(length(array_join(@w, '')) AS BIGINT)",
        n_symbols="CAST(regexp_count(@t, '[#*$%&|<>]') AS BIGINT)",
        n_dup_lines="CAST(size(@lines) - size(array_distinct(@lines)) AS BIGINT)",
        n_repeat_words="aggregate(transform(@q, (x, i) -> least(3, coalesce(get(@q, i + 1) - x, 3))), 0L, (a, x) -> a + x)",
        n_capitals="regexp_count(@t, '\\\\p{Lu}')",
        n_lines="size(@lines)",
    )
    some = "nullif(@n_words, 0)"
    return step(
        f,
        symbols_per_word=f"@n_symbols / {some}",
        capital_share="@n_capitals / nullif(@word_chars, 0)",
        repeat_share=f"@n_repeat_words / {some}",
        dup_line_share="@n_dup_lines / nullif(@n_lines, 0)",
        mean_word_chars=f"@word_chars / {some}",
        base_failed="@n_words < 50 OR 100 * @n_repeat_words > 50 * @n_words",
    ).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(*[F.col(own)[c].alias(c) for c in [*BASE, "base_failed", *MEASURES]]).alias(own),
    )


def fences(groups: DataFrame, least_docs: int = LEAST_DOCS, reach: float = REACH) -> DataFrame:
    """Per lang and source, the struct `fence` of low and high limits of every measure, from (lang, source, rules)."""
    sketches = groups.groupBy("lang", "source").agg(
        F.count("*").alias("docs"),
        *[F.expr(f"kll_sketch_agg_double(rules.{m}, {SKETCH_K})").alias(m) for m in MEASURES],
    )
    sketches = saved(sketches, "quality-sketches")

    merged = [F.sum("docs").alias("docs"), *[F.expr(f"kll_merge_agg_double({m})").alias(m) for m in MEASURES]]
    none = F.lit(None).cast("string")
    pool = sketches.select(F.lit(0).alias("at"), F.col("lang").alias("l"), F.col("source").alias("s"), *MEASURES)
    by_lang = sketches.groupBy("lang").agg(*merged).select(F.lit(1), "lang", none, *MEASURES)
    pool = pool.unionAll(by_lang).unionAll(sketches.agg(*merged).select(F.lit(2), none, none, *MEASURES))
    # The level at which a group finds enough documents: its own, its language, all.
    of_lang = F.sum("docs").over(Window.partitionBy("lang"))
    level = F.when(F.col("docs") >= least_docs, 0).when(of_lang >= least_docs, 1).otherwise(2)
    groups = sketches.select("lang", "source", level.alias("level"))
    chosen = groups.join(
        pool.select("at", "l", "s", F.struct(*MEASURES).alias("k")),
        (F.col("level") == F.col("at"))
        & F.when(F.col("level") < 2, F.col("lang")).eqNullSafe(F.col("l"))
        & F.when(F.col("level") < 1, F.col("source")).eqNullSafe(F.col("s")),
    )
    limits = []
    for m, (least, both) in MEASURES.items():
        n, q = f"kll_sketch_get_n_double(k.{m})", f"kll_sketch_get_quantile_double(k.{m}, array(0.25D, 0.5D, 0.75D))"
        span = f"{reach}D * greatest(get(q, 2) - get(q, 0), {least}D)"
        low = f"get(q, 1) - {span}" if both else "CAST('-Infinity' AS DOUBLE)"
        limit = f"transform(array(IF({n} > 0, {q}, NULL)), q -> struct({low} AS low, get(q, 1) + {span} AS high))[0]"
        limits.append(F.expr(limit).alias(m))
    return saved(chosen.select("lang", "source", F.struct(*limits).alias("fence")), "quality-fences")


def judged(rows: DataFrame, rules: str, limits: DataFrame) -> tuple[DataFrame, Column]:
    """The rows joined with the limits of their group, and whether a row is kept. The small side is one row a group:
    Spark broadcasts it only when its measured size is below the threshold, and splits hot groups otherwise."""
    here = limits.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), "fence")
    names = {c: free_name(rows, c) for c in here.columns}
    here = here.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = rows.join(
        here,
        rows["lang"].eqNullSafe(here[names["fence_lang"]]) & rows["source"].eqNullSafe(here[names["fence_source"]]),
    )
    within = F.lit(True)
    for m in MEASURES:
        value, fence = rows[rules][m], here[names["fence"]][m]
        within &= value.between(fence["low"], fence["high"])
    return joined, ~rows[rules]["base_failed"] & F.coalesce(within, F.lit(False))


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed and kept. Rows that repeat each get a row; a null lang or
    source is a group of its own; no rows give none. Null and empty texts have no words and fail. Very long texts are
    measured whole. Further columns, whatever their names, are left out."""
    few = docs.select(
        docs["doc_id"], docs["lang"].cast("string"), docs["source"].cast("string"), docs["text"]
    )
    rows = measured(few).drop("text").withColumnRenamed("rules_", "rules")
    rows = saved(rows, "quality-measures")
    joined, kept = judged(rows, "rules", fences(rows))
    return joined.select("doc_id", *[rows["rules"][c].alias(c) for c in [*BASE, "base_failed"]], kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were, whatever their names. Null and empty texts go;
    rows that repeat are judged each; very long texts are measured whole; no rows give none."""
    own = free_name(docs, "rules_")
    rows = saved(measured(docs), "quality-documents")
    limits = fences(rows.select(rows["lang"], rows["source"], rows[own].alias("rules")))
    joined, kept = judged(rows, own, limits)
    return joined.where(kept).select(*[rows[c] for c in docs.columns])
