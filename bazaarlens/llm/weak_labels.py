"""Personal data in texts by weak supervision: patterns, gazetteers and contexts vote on candidate spans, expectation-
maximisation over the votes estimates how reliable each labeler is, and the resulting soft labels train the classifier
of spans that decides.

Candidates are the matches of the fixed patterns, with or without their checks, and looser forms: mail addresses in
words, long IP addresses, telephone numbers without a plus sign, capitalised names. Votes are for, none or against, so
the documents reduce to counts of a few thousand possible vote patterns at most; expectation-maximisation runs on those
in one row. The classifier is a damped naive Bayes model over hashed features of a span and its neighbourhood, trained
by one aggregation over all candidates. Only DataFrame functions are used, and places are code points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free_name, saved

#: The kinds with base spans, in the order of the result; names follow.
KINDS = ("email", "ip", "card", "phone", "name")
BASE_KINDS = 4

# The patterns of the base kinds. A lookbehind or \G starts a run of characters at its first one only and
# possessive quantifiers do not go back in it, so the time is linear; what matches is the same.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Looser patterns, and their kinds.
LOOSE = (
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
        r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"),
    (1, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    (3, r"(?<![0-9A-Za-z+.-])(?:\(?[0-9]{2,5}\)?[\x20./-]){1,4}[0-9]{3,5}(?![0-9A-Za-z])"),
    (4, r"(?<!\p{L})(?!(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Sra?|Mme)\b)\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){1,2}(?!\p{L})"),
)
V6 = BASE_KINDS + 1
PART = r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"

#: Gazetteers: endings of mail domains, calling codes, first digits of card issuers, networks of nobody's own, names.
DOMAINS = "com|org|net|edu|gov|info|biz|io|eu|uk|de|fr|es|it|nl|at|ch|be|pt|pl|se|us|ca|mx|br|ar|in|jp|au"
CALLING = r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-3]|[59]0[0-9]|67[0-9]|9[679][0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|64|65"
NETWORKS = r"0|10|127|169\.254|192\.168|255"
GIVEN = (
    "Alice Anna Ana Antonio Bernd Carlos Carmen Charles Claire Daniel David Elena Elizabeth Emma Hans Heinrich Helen "
    "Isabel James Jean Jennifer John Jorge Juan Julia Karin Karl Klaus Laura Linda Lucas Luis Luisa Maria Marie Mark "
    "Martin Mary Michael Michel Miguel Monika Nicole Patricia Paul Pedro Peter Petra Philippe Pierre Robert Sabine "
    "Sarah Sofia Sophie Susan Thomas Ursula William Wolfgang"
).split()
#: Words before a span that speak for its kind, and for none.
CUES = (
    "e-?mail|mail|contact|write|correo|courriel|kontakt",
    "ip|host|address|server|client|adresse",
    "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "tel|telephone|phone|call|fax|mobile|cell|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone|mobil|handy",
    "mr|mrs|ms|dr|prof|herr|frau|sr|sra|mme|name|named|regards|sincerely|signed|nombre|nom",
)
OTHERS = "isbn|issn|version|page|order|invoice|ref|no|nr|id|sku|serial|lot|chapter|section|item|total|price|year|date"
ROLES = r"^(?:info|no-?reply|admin|support|sales|contact|webmaster|postmaster)@"

#: Per labeler, the chances of (against, none, for) where the span is none, and where it is personal data: the first
#: guesses of expectation-maximisation, which stay in it with the weight of STRENGTH spans.
LABELERS = {
    "format": ((0.60, 0.38, 0.02), (0.02, 0.13, 0.85)),
    "shape": ((0.30, 0.45, 0.25), (0.10, 0.40, 0.50)),
    "gazetteer": ((0.30, 0.50, 0.20), (0.10, 0.45, 0.45)),
    "before": ((0.20, 0.75, 0.05), (0.02, 0.58, 0.40)),
    "beside": ((0.30, 0.69, 0.01), (0.05, 0.94, 0.01)),
    "digits": ((0.10, 0.89, 0.01), (0.01, 0.98, 0.01)),
}
SHARE, STRENGTH, ROUNDS = 0.3, 50.0, 30
#: Characters before a candidate that are looked at, as far as no other match of its pattern stands there.
NEAR = 24
#: Features of a span, hash classes of each and kind, weight of the share of the kind in each class, damping of their
#: sum, and the log-odds that a span needs.
FEATURES, CLASSES, SMOOTHING, DAMPING, LEAST = 6, 256, 2.0, 0.5, 2.2
MARK = "[PERSONAL]"

FOUND = "array<struct<s:int,k:int,e:int,v:string,l:string,r:string,ok:boolean,p:int>>"
SPANS = "array<struct<s:int,k:int,e:int>>"


def _text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _like(value: str, pattern: str) -> str:
    return f"{value} RLIKE {_text(pattern)}"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _matches(text: str, found: str, pattern: str, number: int, kind: int, ok: str, wanted: str) -> str:
    """SQL for the wanted matches of a pattern with their places (from the lengths of gaps and matches before) and what
    stands around them; `ok` and `wanted` are SQL on m, the match."""
    return f"""
        IF(size({found}) = 0, CAST(array() AS {FOUND}),
           transform(array(split({text}, {_text(pattern)}, -1)), gaps -> aggregate(
             transform({found}, (m, i) -> named_struct('g', gaps[i], 'm', m, 'r', left(gaps[i + 1], 1), 'ok', {ok}, 'w', {wanted})),
             named_struct('at', 0, 'found', CAST(array() AS {FOUND})),
             (a, x) -> named_struct(
               'at', a.at + length(x.g) + length(x.m),
               'found', IF(x.w, concat(a.found, array(named_struct(
                 's', a.at + length(x.g), 'k', {kind}, 'e', a.at + length(x.g) + length(x.m), 'v', x.m,
                 'l', right(x.g, {NEAR}), 'r', x.r, 'ok', x.ok, 'p', {number}))), a.found)),
             a -> a.found))[0])"""


def _all_matches(text: str, lists: list[str]) -> str:
    digits = f"length({_digits('m')})"
    checks = [
        ("true", "true"),
        (f"NOT exists(split(m, '[.]'), y -> NOT {_like('y', PART)})", "length(m) < 40"),
        (f"IF({digits} BETWEEN 12 AND 19, luhn_check({_digits('m')}), false)", f"{digits} BETWEEN 12 AND 19"),
        (f"{digits} BETWEEN 9 AND 15", f"{digits} BETWEEN 7 AND 15"),
    ]
    # A base span stays a match whatever its length.
    parts = [
        _matches(text, lists[k], BASE[k], k, k, ok, f"({ok}) OR {wanted}") for k, (ok, wanted) in enumerate(checks)
    ]
    for i, (kind, pattern) in enumerate(LOOSE):
        number = BASE_KINDS + i
        wanted = f"{digits} BETWEEN 7 AND 15" if kind == 3 else "true"
        parts.append(_matches(text, lists[number], pattern, number, kind, "false", wanted))
    return f"concat({', '.join(parts)})"


def _by_kind(*cases: str) -> str:
    return "CASE x.k " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


def _votes() -> list[str]:
    """SQL on x, a match: the vote of each labeler, 0 against, 1 none, 2 for."""
    mail = r"(?:\.|\(dot\)|\[dot\])\x20?"
    plain = r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$"
    card = r"^[0-9]{13,16}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$"
    phone = r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^00[1-9]|^\+[1-9]"
    day = r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}$"
    given = "array(" + ", ".join(map(_text, GIVEN)) + ")"
    cue = "CASE x.k " + " ".join(
        f"WHEN {k} THEN " + _like("lower(x.l)", rf"(?:^|\P{{L}})(?:{c})\P{{L}}*(?:is|at|to|on|me|us|:)?\P{{L}}*$")
        for k, c in enumerate(CUES)
    ) + " END"
    other = _like("lower(x.l)", rf"(?:^|\P{{L}})(?:{OTHERS})[^\p{{L}}0-9]*$|[$€£]\x20?$")
    dull = f"size(array_distinct(split({_digits('x.v')}, ''))) <= 2 OR {_digits('x.v')} RLIKE '01234567|12345678|98765432'"
    return [
        f"CASE WHEN x.ok OR x.p = {V6} THEN 2 WHEN x.p < {BASE_KINDS} THEN 0 ELSE 1 END",
        _by_kind(
            f"IF({_like('x.v', mail + '[A-Za-z]{2,6}$')}, 2, 1)",
            f"IF(x.p = {V6}, 1, IF({_like('x.v', plain)}, 2, 0))",
            f"IF({_like('x.v', card)}, 2, 0)",
            f"CASE WHEN {_like('x.v', day)} THEN 0 WHEN {_like('x.v', phone)} THEN 2 ELSE 1 END",
            "1",
        ),
        _by_kind(
            f"IF({_like('x.v', mail + f'(?:{DOMAINS})$')}, 2, 1)",
            f"IF({_like('x.v', rf'^(?:{NETWORKS})\.')}, 0, 1)",
            f"IF({_like('x.v', f'^(?:{ISSUERS})')}, 2, 0)",
            f"IF({_like('x.v', rf'^(?:\+|00)\x20?(?:{CALLING})')}, 2, 1)",
            f"IF(arrays_overlap(split(x.v, ' '), {given}), 2, 1)",
        ),
        f"CASE WHEN {cue} THEN 2 WHEN {other} THEN 0 ELSE 1 END",
        f"IF({_like('x.r', '[A-Za-z0-9_%/=]')} OR {_like('x.l', '[A-Za-z0-9_/=.]$')}, 0, 1)",
        f"CASE WHEN x.k BETWEEN 1 AND 3 AND ({dull}) THEN 0 WHEN x.k = 0 AND {_like('lower(x.v)', ROLES)} THEN 0 ELSE 1 END",
    ]


def _features(format_vote: str) -> str:
    """SQL on x, a match: the classes of its features, each numbered within its feature and kind."""
    shape = "regexp_replace(regexp_replace(x.v, '[0-9]', '9'), '[A-Za-z]+', 'a')"
    beside = "CASE WHEN x.r = '' THEN 0 WHEN x.r RLIKE '[A-Za-z]' THEN 1 WHEN x.r RLIKE '[0-9]' THEN 2 WHEN x.r RLIKE '[\\\\s.,;:!?)]' THEN 3 ELSE 4 END"
    values = [
        format_vote,
        f"pmod(xxhash64({shape}), {CLASSES})",
        f"pmod(xxhash64(regexp_extract(lower(x.l), '(\\\\p{{L}}+)[^\\\\p{{L}}]*$', 1)), {CLASSES})",
        beside,
        f"least(length(x.v) div 4, {CLASSES - 1})",
        f"pmod(xxhash64(left(x.v, 2)), {CLASSES})",
    ]
    return "array(" + ", ".join(
        f"CAST((({i} * {len(KINDS)}) + x.k) * {CLASSES} + {v} AS INT)" for i, v in enumerate(values)
    ) + ")"


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the struct `pii_` of base spans (base) and all candidates (all: s, k, e, ok, the number of their
    vote pattern, and their features)."""
    own = free_name(docs, "pii_")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(docs[text_col], F.lit(""))
    patterns = [*BASE, *(p for _, p in LOOSE)]
    lists = [F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate(patterns)]
    f = docs.select(*kept, F.struct(text.alias("t"), *lists).alias(own))
    found = _all_matches(f"{own}.t", [f"{own}.m{i}" for i in range(len(patterns))])
    f = f.withColumn(own, F.expr(found))
    votes = _votes()
    pattern = " + ".join(f"{3**i} * ({v})" for i, v in enumerate(votes))
    number = f"CAST(x.k * {3 ** len(votes)} + {pattern} AS INT)"
    every = f"""transform({own}, x -> named_struct(
        's', x.s, 'k', x.k, 'e', x.e, 'ok', x.ok, 'votes', {number}, 'f', {_features(votes[0])}))"""
    return f.withColumn(
        own,
        F.struct(
            F.expr(f"sort_array(transform(filter({own}, x -> x.ok), x -> struct(x.s AS s, x.k AS k, x.e AS e)))").alias("base"),
            F.expr(every).alias("all"),
        ),
    )


def reliabilities(scans: DataFrame) -> DataFrame:
    """One row: `odds`, the log-odds of every kind, and `says`, those of every labeler and vote, by expectation-
    maximisation over the counts of vote patterns in the struct `scan`."""
    n, kinds = len(LABELERS), len(KINDS)
    counts = scans.select(F.explode("scan.all").alias("x")).groupBy("x.votes").agg(F.count("*").alias("n"))
    # No more rows than vote patterns.
    votes = ", ".join(f"CAST(votes div {3**i} AS INT) % 3" for i in range(n))
    rows = counts.select(F.expr(f"struct(CAST(votes div {3**n} AS INT) AS k, array({votes}) AS v, CAST(n AS DOUBLE) AS n)").alias("p"))
    rows = rows.agg(F.collect_list("p").alias("rows"))
    # Index of a chance: (labeler * 3 + vote) * 2 + class.
    first = [chances[c][v] for chances in LABELERS.values() for v in range(3) for c in (0, 1)]
    start = "array(" + ", ".join(f"{x}D" for x in first) + ")"
    shares = f"array_repeat({SHARE}D, {kinds})"
    chance = "aggregate(sequence(0, {n1}), {prior}, (a, l) -> a + ln(st.th[(l * 3 + p.v[l]) * 2 + {c}]))"
    chances = [chance.format(n1=n - 1, c=c, prior=f"ln({x})") for c, x in enumerate(("1 - st.pi[p.k]", "st.pi[p.k]"))]
    expected = f"transform(rows, p -> struct(p.k AS k, p.v AS v, p.n AS n, p.n / (1 + exp({chances[0]} - {chances[1]})) AS q))"
    mass = "IF(j % 2 = 1, e.q, e.n - e.q)"
    th = f"""transform(sequence(0, {6 * n - 1}), j ->
        ({STRENGTH}D * {start}[j] + aggregate(es, 0D, (a, e) -> a + IF(e.v[j div 6] = (j div 2) % 3, {mass}, 0D)))
        / ({STRENGTH}D + aggregate(es, 0D, (a, e) -> a + {mass})))"""
    pi = f"""transform(sequence(0, {kinds - 1}), k ->
        ({STRENGTH * SHARE}D + aggregate(es, 0D, (a, e) -> a + IF(e.k = k, e.q, 0D)))
        / ({STRENGTH}D + aggregate(es, 0D, (a, e) -> a + IF(e.k = k, e.n, 0D))))"""
    step = f"transform(array({expected}), es -> named_struct('pi', {pi}, 'th', {th}))[0]"
    state = "struct<pi:array<double>,th:array<double>>"
    fitted = rows.select(
        F.expr(
            f"aggregate(sequence(1, {ROUNDS}), CAST(named_struct('pi', {shares}, 'th', {start}) AS {state}), "
            f"(st, i) -> CAST({step} AS {state}))"
        ).alias("st")
    )
    return fitted.select(
        F.expr("transform(st.pi, x -> ln(x / (1 - x)))").alias("odds"),
        F.expr(f"transform(sequence(0, {3 * n - 1}), j -> ln(st.th[j * 2 + 1] / st.th[j * 2]))").alias("says"),
    )


def classifier(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: `kinds`, the log-odds of every kind, and `weights`, what each class of a feature adds to them, from the
    soft labels that the reliabilities give to all candidates in the struct `scan`."""
    n, size = len(LABELERS), FEATURES * len(KINDS) * CLASSES
    said = " + ".join(f"says[{3 * i} + CAST(x.votes div {3**i} AS INT) % 3]" for i in range(n))
    rows = scans.select(F.explode("scan.all").alias("x")).join(F.broadcast(labels), F.lit(True))
    rows = rows.select("x.k", "x.f", F.expr(f"1 / (1 + exp(-(odds[x.k] + {said})))").alias("q"))
    # No more groups than classes; the first feature has each candidate once, so that its sums are the kinds'.
    sums = rows.select(F.explode("f").alias("id"), "q").groupBy("id").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    # Sums of doubles depend on the order in the last digits; whole millionths don't.
    sums = sums.select("id", F.round("yes", 6).alias("yes"), F.round("no", 6).alias("no"))
    grid = scans.sparkSession.range(size).select(F.col("id").cast("int")).join(sums, "id", "left").na.fill(0.0, ["yes", "no"])
    row = grid.agg(F.sort_array(F.collect_list(F.struct("id", "yes", "no"))).alias("c"))
    kinds = f"""transform(sequence(0, {len(KINDS) - 1}), k -> aggregate(
        slice(c, k * {CLASSES} + 1, {CLASSES}), named_struct('yes', {SMOOTHING * SHARE}D, 'no', {SMOOTHING * (1 - SHARE)}D),
        (a, x) -> named_struct('yes', a.yes + x.yes, 'no', a.no + x.no), a -> a.yes / (a.yes + a.no)))"""
    row = row.withColumn("kinds", F.expr(kinds))
    share = f"kinds[(x.id div {CLASSES}) % {len(KINDS)}]"
    weight = f"ln((x.yes + {SMOOTHING}D * {share}) / (x.no + {SMOOTHING}D * (1 - {share}))) - ln({share} / (1 - {share}))"
    return row.select(
        F.expr("transform(kinds, x -> ln(x / (1 - x)))").alias("kinds"), F.expr(f"transform(c, x -> {weight})").alias("weights")
    )


def with_spans(rows: DataFrame, scan: str, model: DataFrame) -> DataFrame:
    """The rows with the struct `spans_` of base and all spans, sorted. `model` is one row of a fixed size.

    A span is added if the classifier gives it the odds and at least one labeler votes for it. Of added spans none overlaps a base span, and of two that overlap the one that starts first stays, at the same start
    that of the first kind."""
    own, kinds, weights = (free_name(rows, f"{x}_") for x in ("spans", "kinds", "weights"))
    f = rows.join(F.broadcast(model.select(F.col("kinds").alias(kinds), F.col("weights").alias(weights))), F.lit(True))
    score = f"{kinds}[x.k] + {DAMPING}D * aggregate(x.f, 0D, (a, i) -> a + {weights}[i])"
    backed = " OR ".join(f"CAST(x.votes div {3**i} AS INT) % 3 = 2" for i in range(len(LABELERS)))
    more = f"transform(filter({scan}.all, x -> NOT x.ok AND ({backed}) AND {score} >= {LEAST}D), x -> struct(x.s AS s, 1 AS more, x.k AS k, x.e AS e))"
    marked = f"transform({scan}.base, x -> struct(x.s AS s, 0 AS more, x.k AS k, x.e AS e))"
    # In the order of their starts: a base span takes away the last added one if that reaches into it.
    last = "IF(size(a.added) > 0, element_at(a.added, -1).e, 0)"
    sweep = f"""aggregate(sort_array(concat({marked}, {more})),
        named_struct('base', 0, 'added', CAST(array() AS {SPANS})),
        (a, x) -> named_struct(
          'base', IF(x.more = 0, greatest(a.base, x.e), a.base),
          'added', CASE
            WHEN x.more = 0 AND {last} > x.s THEN slice(a.added, 1, size(a.added) - 1)
            WHEN x.more = 1 AND x.s >= a.base AND x.s >= {last}
              THEN concat(a.added, array(named_struct('s', x.s, 'k', x.k, 'e', x.e)))
            ELSE a.added END),
        a -> a.added)"""
    every = f"IF(exists({scan}.all, x -> NOT x.ok), sort_array(concat({scan}.base, {sweep})), {scan}.base)"
    return f.withColumn(own, F.struct(F.col(scan)["base"].alias("base"), F.expr(every).alias("every"))).drop(kinds, weights)


def trained(scans: DataFrame) -> DataFrame:
    """The classifier of spans for scans with the struct `scan`."""
    return classifier(scans, reliabilities(scans))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the hash of their spans, and all spans as kind:start:end.

    Null and empty texts have no spans (and the hash of nothing); rows that repeat each get a row and count each in the
    training; no rows give none. Very long texts are scanned whole, in one pass per pattern. Spans that start together
    stand in the order of their kinds. Further columns, whatever their names, are left out.
    """
    rows = scanned(docs.select(docs["doc_id"], docs["text"])).drop("text")
    rows = saved(rows.withColumnRenamed("pii_", "scan"), "personal-data")
    f = with_spans(rows, "scan", trained(rows))
    names = "array(" + ", ".join(map(_text, KINDS)) + ")"
    text = f"array_join(transform({{}}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    counts = [
        F.expr(f"CAST(size(filter(spans_.base, x -> x.k = {k})) AS BIGINT)").alias(f"n_{kind}")
        for k, kind in enumerate(KINDS[:BASE_KINDS])
    ]
    return f.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(text.format("spans_.base")), 256).alias("base_sha256"),
        F.expr(text.format("spans_.every")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """All documents, with a mark in place of every span; spans that overlap become one mark. n_chars,
    where there is one, follows. A null text stays."""
    scan = free_name(docs, "pii_")
    rows = saved(scanned(docs), "personal-documents")
    f = with_spans(rows, scan, trained(rows.select(F.col(scan).alias("scan"))))
    spans = next(c for c in f.columns if c not in rows.columns)
    cut = f"""aggregate({spans}.every, named_struct('o', '', 'at', 0), (a, x) -> named_struct(
                'o', IF(x.s >= a.at, concat(a.o, substring(text, a.at + 1, x.s - a.at), {_text(mark)}), a.o),
                'at', greatest(a.at, x.e)), a -> concat(a.o, substring(text, a.at + 1)))"""
    some = F.size(F.col(spans)["every"]) > 0
    f = f.withColumn("text", F.when(some, F.expr(cut)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        f = f.withColumn("n_chars", F.when(some, n).otherwise(F.col("n_chars")))
    return f.select(*[F.col(f"`{c}`") for c in docs.columns])
