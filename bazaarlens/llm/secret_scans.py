"""Secrets in texts: fixed patterns, and strings that a Markov model of random characters explains better than one of
ordinary identifiers.

Both models count neighbouring characters. The labelled samples come from the documents: what the fixed patterns match
is random, long runs of letters without a digit are ordinary identifiers. A run of letters and digits whose
log-likelihood ratio is large is one more span. Only DataFrame functions are used, and places are code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free_name, saved

#: Java patterns of the base kinds, in the order of the result, and least lengths of the group in question.
KINDS = {
    "assign": (
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
METHOD = "markov"
#: Runs that the models judge, and the characters that they know.
RUN = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Nats by which the random model must explain a run better.
LEAST_RATIO = 5.0
#: Added to the count of every pair, in both models.
SMOOTHING = 0.5
#: Shares of the counted pairs in the models of ordinary and random strings; the rest is an even chance for every
#: character, so that random strings unlike those in the samples are still more likely random.
COUNTED = (0.9, 0.5)
MARK = "[SECRET]"

SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, matches: str, pattern: str, kind: int, wanted: str) -> str:
    """SQL for the spans of the matches of a pattern that are wanted (SQL on m, the match, and i, its number): their
    places are the lengths of the gaps and matches before."""
    return f"""
        IF(size({matches}) = 0, CAST(array() AS {SPANS}),
           transform(array(split({text}, {_literal(pattern)}, -1)), gaps -> aggregate(
             transform({matches}, (m, i) -> struct(length(gaps[i]) AS g, length(m) AS n, m AS m, {wanted} AS ok)),
             named_struct('at', 0, 'found', CAST(array() AS {SPANS})),
             (a, x) -> named_struct('at', a.at + x.g + x.n, 'found', IF(x.ok,
               concat(a.found, array(named_struct('s', a.at + x.g, 'k', {kind}, 'e', a.at + x.g + x.n, 'v', x.m))),
               a.found)),
             a -> a.found))[0])"""


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the struct `scan_`: base spans, other runs with letters and digits, and ordinary identifiers."""
    own = free_name(docs, "scan_")
    all_columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(docs[text_col], F.lit(""))
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"m{k}") for k, (p, _, _) in enumerate(KINDS.values())]
    values = F.regexp_extract_all(text, F.lit(KINDS["assign"][0]), F.lit(2))
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("runs")
    f = docs.select(*all_columns, F.struct(text.alias("t"), *found, runs).alias(own))
    # The second group of assignments is looked for only where there are some.
    f = f.withColumn(own, F.col(own).withField("v0", F.when(F.size(F.col(own)["m0"]) > 0, values)))
    spans = []
    for k, (pattern, group, least) in enumerate(KINDS.values()):
        wanted = f"length(get({own}.v{k}, i)) >= {least}" if group else f"length(m) >= {least}"
        spans.append(_spans(f"{own}.t", f"{own}.m{k}", pattern, k, wanted))
    mixed = "(m RLIKE '[0-9]' AND m RLIKE '[A-Za-z]')"
    others = f"""IF(exists({own}.runs, m -> {mixed}), {_spans(f"{own}.t", f"{own}.runs", RUN, len(KINDS), mixed)},
                 CAST(array() AS {SPANS}))"""
    f = f.withColumn(
        own,
        F.struct(
            F.expr(f"concat({', '.join(spans)})").alias("base"),
            F.expr(others).alias("others"),
            F.expr(f"filter({own}.runs, m -> NOT m RLIKE '[0-9]')").alias("ordinary"),
            F.expr(f"concat(filter({own}.v0, v -> length(v) >= {KINDS['assign'][2]}), array())").alias("values"),
        ),
    )
    return f


def ratios(scans: DataFrame) -> DataFrame:
    """One row: `ratio`, the log-likelihood ratio of every pair of characters, by their places in the alphabet."""
    size = len(ALPHABET)
    samples = scans.select(
        F.explode(
            F.expr(
                "concat(transform(scan.ordinary, v -> struct(0 AS random, v AS v)), "
                "transform(coalesce(scan.values, array()), v -> struct(1 AS random, v AS v)), "
                "transform(filter(scan.base, x -> x.k > 0), x -> struct(1 AS random, x.v AS v)))"
            )
        ).alias("x")
    ).where("length(x.v) > 1")
    pairs = samples.select(
        "x.random", F.explode(F.expr("transform(sequence(1, length(x.v) - 1), i -> substring(x.v, i, 2))")).alias("pair")
    )
    counts = pairs.groupBy("random", "pair").agg(F.count("*").alias("n"))

    first, second = (F.instr(F.lit(ALPHABET), F.substring("pair", i, 1)) - 1 for i in (1, 2))
    counts = counts.select((first * size + second).alias("id"), "random", "n").groupBy("id").agg(
        *[F.sum(F.when(F.col("random") == r, F.col("n")).otherwise(0)).alias(f"n{r}") for r in (0, 1)]
    )
    grid = scans.sparkSession.range(size * size).join(counts, "id", "left").na.fill(0, ["n0", "n1"])
    rows = grid.withColumn("a", F.floor(F.col("id") / size)).groupBy("a").agg(
        *[F.sum(f"n{r}").alias(f"t{r}") for r in (0, 1)], F.collect_list(F.struct("id", "n0", "n1")).alias("cells")
    )
    chance = [
        f"ln({w}D * (c.n{r} + {SMOOTHING}D) / (t{r} + {SMOOTHING * size}D) + {1 - w}D / {size})" for r, w in enumerate(COUNTED)
    ]
    cell = f"{chance[1]} - {chance[0]}"
    cells = rows.select(F.explode(F.expr(f"transform(cells, c -> struct(c.id AS id, {cell} AS r))")).alias("c"))
    return cells.agg(F.expr("transform(sort_array(collect_list(c)), c -> c.r)").alias("ratio"))


def with_spans(rows: DataFrame, scan: str, model: DataFrame) -> DataFrame:
    """The rows with the struct `spans_` of base and all spans, sorted. `model` is one row of a fixed size."""
    own = free_name(rows, "spans_")
    ratio = free_name(rows, "ratio_")
    f = rows.join(F.broadcast(model.select(F.col("ratio").alias(ratio))), F.lit(True))
    size = len(ALPHABET)
    at = "instr('" + ALPHABET + "', substring(x.v, {}, 1)) - 1"
    pair = f"get({ratio}, ({at.format('i')}) * {size} + {at.format('i + 1')})"
    score = f"aggregate(sequence(1, length(x.v) - 1), 0D, (a, i) -> a + {pair})"
    apart = f"NOT exists({scan}.base, b -> b.s < x.e AND x.s < b.e)"
    order = "sort_array(transform({}, x -> struct(x.s AS s, x.k AS k, x.e AS e)))"
    more = f"filter({scan}.others, x -> {apart} AND {score} >= {LEAST_RATIO}D)"
    return f.withColumn(
        own,
        F.struct(
            F.expr(order.format(f"{scan}.base")).alias("base"),
            F.expr(order.format(f"concat({scan}.base, {more})")).alias("every"),
        ),
    ).drop(ratio)


def secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the hash of their spans, and all spans as kind:start:end.

    Null and empty texts have no spans (and the hash of nothing); rows that repeat each get a row; no rows give none. Very
    long texts are scanned whole. Spans that start together stand in the order of their kinds. Further columns, whatever
    their names, are left out.
    """
    rows = scanned(docs.select(docs["doc_id"], docs["text"])).drop("text")
    rows = saved(rows.withColumnRenamed("scan_", "scan"), "secret-scans")
    f = with_spans(rows, "scan", ratios(rows))
    names = "array(" + ", ".join(f"'{k}'" for k in [*KINDS, METHOD]) + ")"
    text = f"array_join(transform({{}}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    counts = [
        F.expr(f"CAST(size(filter(spans_.base, x -> x.k = {k})) AS BIGINT)").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS)
    ]
    return f.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(text.format("spans_.base")), 256).alias("base_sha256"),
        F.expr(text.format("spans_.every")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars, where there is one, follows. A null text stays."""
    scan = free_name(docs, "scan_")
    rows = saved(scanned(docs), "secret-documents")
    f = with_spans(rows, scan, ratios(rows.select(F.col(scan).alias("scan"))))
    spans = next(c for c in f.columns if c not in rows.columns)
    cut = f"""aggregate({spans}.every, named_struct('o', '', 'at', 0), (a, x) -> named_struct(
                'o', IF(x.s >= a.at, concat(a.o, substring(text, a.at + 1, x.s - a.at), {_literal(mark)}), a.o),
                'at', greatest(a.at, x.e)), a -> concat(a.o, substring(text, a.at + 1)))"""
    text = F.when(F.size(F.col(spans)["every"]) > 0, F.expr(cut)).otherwise(F.col("text"))
    f = f.withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        f = f.withColumn("n_chars", F.when(F.size(F.col(spans)["every"]) > 0, n).otherwise(F.col("n_chars")))
    return f.select(*[F.col(f"`{c}`") for c in docs.columns])
