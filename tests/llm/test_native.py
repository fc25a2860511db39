"""Quality rules and secret scans against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from bazaarlens.llm import quality_rules, secret_scans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rules_ int, scan_ int, spans_ int, w string"


def quality_texts():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 90)) for _ in range(300)]
    texts += [" ".join(w + "###" for w in rng.choice(words, 90)) for _ in range(20)]
    texts += [t.upper() for t in texts[:20]]
    texts += ["", None, " \n\t ", "a", "a b", "a a a", "x y z x y z", "one line\none line\n\n \none line", "\x1c\x85 \xa0b"]
    texts += ["spam " * 60, ("again and again " * 3 + " ".join(words[:80]) + "\n") * 2, "w " * 30000, texts[0], texts[0]]
    return texts


@pytest.fixture(scope="module")
def quality_docs(spark):
    rows = []
    for i, t in enumerate(quality_texts()):
        rows.append((i, t, ["en", None, "fr"][min(2, i % 7)], "hot" if i % 3 else f"s{i % 4}", len(t or ""), 1, 2, 3, "x"))
    rows.append(rows[0])
    rows.append((None, "no id", "en", None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def measures(text):
    words = WORD.findall(text or "")
    n = len(words)
    places = defaultdict(list)
    for i in range(n - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    capitals = sum(c.isupper() for c in text or "")
    share = (symbols / n, capitals / chars, len(covered) / n, dup / len(lines), chars / n) if n else None
    return (n, chars, symbols, dup, len(covered)), n < 50 or 100 * len(covered) > 50 * n, share


def test_quality(spark, quality_docs):
    rows = quality_docs.collect()
    by_group, by_lang, overall = defaultdict(list), defaultdict(list), []
    for r in rows:
        share = measures(r.text)[2]
        for held in (by_group[r.lang, r.source], by_lang[r.lang], overall):
            held.append(share)

    def fence(k, values):
        least, both = list(quality_rules.MEASURES.values())[k]
        values = sorted(v[k] for v in values if v)
        # the smallest value whose rank reaches the share, as the sketch gives it while it holds all values
        q = [values[max(0, math.ceil(p * len(values)) - 1)] for p in (0.25, 0.5, 0.75)]
        span = quality_rules.REACH * max(q[2] - q[0], least)
        return (q[1] - span if both else -math.inf), q[1] + span

    def kept(r):
        _, failed, share = measures(r.text)
        held = next(
            h for h in (by_group[r.lang, r.source], by_lang[r.lang], overall)
            if len(h) >= quality_rules.LEAST_DOCS or h is overall
        )
        return not failed and all(lo <= share[k] <= hi for k in range(5) for lo, hi in [fence(k, held)])

    got = Counter(map(tuple, quality_rules.quality(quality_docs).collect()))
    want = Counter((r.doc_id, *measures(r.text)[0], measures(r.text)[1], kept(r)) for r in rows)
    assert got == want
    assert 250 < sum(n for k, n in want.items() if k[-1]) < 320
    good = quality_rules.keep_good(quality_docs)
    assert good.columns == quality_docs.columns
    assert Counter(map(tuple, good.collect())) == Counter(tuple(r) for r in rows if kept(r))
    assert quality_rules.quality(quality_docs.limit(0)).count() == 0
    assert quality_rules.keep_good(quality_docs.limit(0)).count() == 0


SECRETS = [
    "", None, "nothing here", "password=abc", "password=abcdef", 'API_KEY : "abc.def=/+" token=token:abcdefgh',
    "🙂é SECRET='x1y2z3' AKIA" + "Z9" * 8 + " 🙂 " + "0123456789abcdef" * 2, "AKIAAKIA12 AKIA" + "A" * 16,
    "token=secret=abcdef password = password = abcdef", "passwd:   \"abcdefg\" apikey=1", "deadbeef" * 3 + "g" + "f" * 23,
    "tokentoken=aaaaaaa token==abcdef", "key q7zx2lpv9mtrx4kwj8bnq3ydz6hcv end", "ordinaryidentifier " * 40 + "counter_of_rows_in_table2",
    "AKIA" + "B" * 3000, "token=abcdef " * 300, "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"", "\x0btoken=\nabcdef",
    "ſecret=abcdefg toKen=abcdefg",
    " ".join(a + b + c for a in ("running", "Counting", "HTTP", "maximal") for b in ("over", "Under", "_of_") for c in ("columns", "Tables", "identifiers")),
]
FIXED = {
    "assign": re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}



def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(FIXED.items()):
        for m in p.finditer(text or ""):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end(), m.group(2) if kind == "assign" else m.group()))
    return sorted(out)


def all_spans(texts):
    """Base spans of each text and what the two models add."""
    size = len(secret_scans.ALPHABET)
    place = {c: i for i, c in enumerate(secret_scans.ALPHABET)}
    n = np.zeros((2, size, size))
    runs = [[(m.start(), m.end(), m.group()) for m in re.finditer(secret_scans.RUN, t or "")] for t in texts]
    for t, found in zip(texts, runs):
        samples = [(0, v) for _, _, v in found if not re.search("[0-9]", v)] + [(1, x[3]) for x in base_spans(t)]
        for r, v in samples:
            for a, b in zip(v, v[1:]):
                n[r, place[a], place[b]] += 1
    s = secret_scans.SMOOTHING
    p = (n + s) / (n.sum(2, keepdims=True) + s * size)
    p = [np.log(w * p[r] + (1 - w) / size) for r, w in enumerate(secret_scans.COUNTED)]
    out = []
    for t, found in zip(texts, runs):
        base = base_spans(t)
        more = [
            (a, 3, b, v) for a, b, v in found
            if re.search("[0-9]", v) and re.search("[A-Za-z]", v)
            and sum((p[1] - p[0])[place[x], place[y]] for x, y in zip(v, v[1:])) >= secret_scans.LEAST_RATIO
            and not any(x[0] < b and a < x[2] for x in base)
        ]
        out.append((base, sorted(base + more)))
    return out


@pytest.fixture(scope="module")
def secret_docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "x") for i, t in enumerate(SECRETS)]
    rows += [rows[5], (None, "token=abcdef", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_secrets(spark, secret_docs):
    rows = secret_docs.collect()
    want = Counter()
    names = [*FIXED, "markov"]
    for r, (base, every) in zip(rows, all_spans([r.text for r in rows])):
        joined = [",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in x) for x in (base, every)]
        counts = [sum(x[1] == k for x in base) for k in range(3)]
        want[r.doc_id, *counts, hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]] += 1
    got = Counter(map(tuple, secret_scans.secrets(secret_docs).collect()))
    assert got == want
    assert any("markov" in k[-1] for k in want)
    assert secret_scans.secrets(secret_docs.limit(0)).count() == 0


def test_redaction(spark, secret_docs):
    rows = secret_docs.collect()
    want = Counter()
    for r, (_, every) in zip(rows, all_spans([r.text for r in rows])):
        out, at = "", 0
        for a, _, b, _ in every:
            if a >= at:
                out += r.text[at:a] + secret_scans.MARK
            at = max(at, b)
        row = r.asDict()
        if every:
            row["text"] = out + r.text[at:]
            row["n_chars"] = len(row["text"])
        want[tuple(row.values())] += 1
    got = secret_scans.redacted(secret_docs)
    assert got.schema.simpleString() == secret_docs.schema.simpleString()
    assert Counter(map(tuple, got.collect())) == want
    assert secret_scans.redacted(secret_docs.limit(0)).count() == 0


def test_plans_are_native(spark, quality_docs, secret_docs):
    for frame in (
        quality_rules.quality(quality_docs), quality_rules.keep_good(quality_docs),
        secret_scans.secrets(secret_docs), secret_scans.redacted(secret_docs),
    ):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
