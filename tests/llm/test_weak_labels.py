"""Personal data against plain Python: fixed patterns, expectation-maximisation, the classifier, and planted spans."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import weak_labels as W

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pii_ int, spans_ int, KINDS_ int, weights_ string"
FIXED = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in double) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return [
        True, kind == 1 and all(int(p) <= 255 for p in match.split(".")),
        12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15,
    ][kind]


def base_spans(text):
    return sorted(
        (m.start(), k, m.end()) for k, p in enumerate(FIXED) for m in re.finditer(p, text or "") if holds(k, m[0])
    )


def planted(rng, n):
    """Texts, and per text the places of personal data in forms that the fixed patterns don't match."""
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    words = "onto there rather winter golden paper letters of the and house under".split()
    mails = [lambda: f"{rng.choice(words)}.{digits(2)} (at) {rng.choice(words)}{digits(1)} (dot) com"]
    phones = [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"]
    names = [lambda: f"{rng.choice(W.GIVEN)} {rng.choice(['Miller', 'Weber', 'Lopez', 'Dupont'])}"]
    good = [("mail ", mails), ("please call ", phones), ("phone: ", phones), ("Mr ", names), ("regards, ", names)]
    number = lambda k: str(rng.integers(1, 10)) + digits(k - 1)
    bad = [
        lambda: f"order {digits(5)}-{digits(4)}", lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}", lambda: f"on 2021-{digits(2)}-{digits(2)}00",
        lambda: f"version {digits(3)}.{digits(3)}.{digits(3)}", lambda: "Green House", lambda: "Old Town Hall", lambda: f"total {number(16)}",
        lambda: f"{number(7)}", lambda: f"page {digits(3)}/{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.999.{digits(2)}",
    ]
    usual = [lambda: f"{rng.choice(words)}@{rng.choice(words)}.com", lambda: f"+49 {digits(3)} {digits(7)}", lambda: f"10{digits(1)}.{digits(2)}.7.9"]
    out = []
    for _ in range(n):
        text, spans = "", set()
        for _ in range(6):
            text += " ".join(rng.choice(words, rng.integers(3, 8))) + " "
            pick = rng.random()
            if pick < 0.35:
                before, forms = good[rng.integers(len(good))]
                value = forms[rng.integers(len(forms))]()
                text += before
                spans.add((len(text), len(text) + len(value)))
                text += value + ", "
            elif pick < 0.6:
                text += str(bad[rng.integers(len(bad))]()) + " "
            elif pick < 0.8:
                text += usual[rng.integers(len(usual))]() + " "
        out.append((text, spans))
    return out


ODD = [
    "", None, "nothing", "a@b.c_d@e.f g@h", "@x.y a@@b.c a@b..c x.@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.1.10 9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 378282246310005-", "+1 (603) 555-8791 +49 30 1234567-8) +1 2 ++12345678901234567",
    "🙂é +1 (603) 555-8791 é a@b.co 🙂 4111111111111111", "5" * 5000, "1." * 5000, "a" * 20000 + "@", "+1" + "-" * 5000 + "1",
    "a.b@c.d, 1.2.3.4 and 00491234567890", "+4111 1111 1111 1111", "Mr. John Smith and Ana Maria Lopez", "2001:0db8:0:0:0:0:2:1 x",
    "call (603) 555-8791 tel 603-555-8791 phone 0043 1 5555555 on 2020-12-24-12", "john (at) mail (dot) com and me[at]x.org", "٣٤٥٦ ４１１１",
    " ".join(f"call 603-555-{i}, mail a{i}@b.com" for i in range(1000, 3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + [t for t, _ in planted(np.random.default_rng(2), 300)]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 3, "x") for i, t in enumerate(texts)]
    rows += [rows[17]] * 30 + [(None, "a@b.co", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def votes_of(number):
    n = len(W.LABELERS)
    return number // 3**n, [number // 3**i % 3 for i in range(n)]


def fitted(numbers):
    """Soft labels of vote patterns by expectation-maximisation."""
    first = np.array([list(zip(*c)) for c in W.LABELERS.values()])  # labeler, vote, class
    seen = [(*votes_of(x), n) for x, n in sorted(Counter(numbers).items())]
    pi, th = np.full(len(W.KINDS), W.SHARE), first.copy()

    def expected():
        out = []
        for k, v, n in seen:
            p = [np.log((1 - pi[k], pi[k])[c]) + sum(np.log(th[i, x, c]) for i, x in enumerate(v)) for c in (0, 1)]
            out.append(1 / (1 + np.exp(p[0] - p[1])))
        return out

    for _ in range(W.ROUNDS):
        mass, total = W.STRENGTH * first, np.full(2, W.STRENGTH)
        by_kind, all_kind = np.full(len(W.KINDS), W.STRENGTH * W.SHARE), np.full(len(W.KINDS), W.STRENGTH)
        for (k, v, n), q in zip(seen, expected()):
            for c, m in enumerate((n * (1 - q), n * q)):
                total[c] += m
                for i, x in enumerate(v):
                    mass[i, x, c] += m
            by_kind[k] += n * q
            all_kind[k] += n
        th, pi = mass / total, by_kind / all_kind
    labels = {}
    for k, v, _ in seen:
        p = [np.log((1 - pi[k], pi[k])[c]) + sum(np.log(th[i, x, c]) for i, x in enumerate(v)) for c in (0, 1)]
        labels[k, tuple(v)] = 1 / (1 + np.exp(p[0] - p[1]))
    return labels


def plain(scans):
    """All spans of each scan (base, all)."""
    labels = fitted([x.votes for s in scans for x in s.all])
    yes, no = Counter(), Counter()
    kinds = np.array([[W.SMOOTHING * (1 - W.SHARE), W.SMOOTHING * W.SHARE]] * len(W.KINDS))
    for s in scans:
        for x in s.all:
            k, v = votes_of(x.votes)
            q = labels[k, tuple(v)]
            kinds[x.k] += (1 - q, q)
            for i in x.f:
                yes[i] += q
                no[i] += 1 - q
    share = kinds[:, 1] / kinds.sum(1)
    odds = np.log(share / (1 - share))

    def score(x):
        p = share[x.k]
        return odds[x.k] + W.DAMPING * sum(
            np.log((yes[i] + W.SMOOTHING * p) / (no[i] + W.SMOOTHING * (1 - p))) - odds[x.k] for i in x.f
        )

    out = []
    for s in scans:
        base = [tuple(x) for x in s.base]
        rows = sorted([(a, 0, k, b) for a, k, b in base] + [(x.s, 1, x.k, x.e) for x in s.all if not x.ok and 2 in votes_of(x.votes)[1] and score(x) >= W.LEAST])
        added, reach = [], 0
        for a, more, k, b in rows:
            if not more:
                reach = max(reach, b)
                if added and added[-1][2] > a:
                    added.pop()
            elif a >= reach and (not added or a >= added[-1][2]):
                added.append((a, k, b))
        out.append(sorted(base + added))
    return out


def test_personal_data(docs):
    scans = W.scanned(docs).collect()
    want = Counter()
    for r, every in zip(scans, plain([r["pii__"] for r in scans])):
        base = base_spans(r.text)
        assert [tuple(x) for x in r["pii__"].base] == base
        joined = [",".join(f"{W.KINDS[k]}:{a}:{b}" for a, k, b in x) for x in (base, every)]
        counts = [sum(x[1] == k for x in base) for k in range(4)]
        want[r.doc_id, *counts, hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]] += 1
    found = W.personal_data(docs)
    assert Counter(map(tuple, found.collect())) == want
    assert W.personal_data(docs.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_planted_spans(spark):
    """Spans added where there is personal data, and nowhere else; the fixed patterns find none of these."""
    texts = planted(np.random.default_rng(7), 600)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    hits = added = there = 0
    for r in W.personal_data(rows).collect():
        text, spans = texts[r.doc_id]
        base = {(a, b) for a, _, b in base_spans(text)}
        more = {tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x} - base
        hits, added, there = hits + len(more & spans), added + len(more), there + len(spans)
    print(f"precision {hits / added:.3f}, recall {hits / there:.3f}")
    assert hits / added > 0.95 and hits / there > 0.9


def test_redaction(docs):
    rows = docs.collect()
    spans = {}
    for r in W.personal_data(docs).collect():
        spans[r.doc_id] = sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x)
    want = Counter()
    for r in rows:
        row, out, at = r.asDict(), "", 0
        for a, b in spans[r.doc_id]:
            if a >= at:
                out += r.text[at:a] + W.MARK
            at = max(at, b)
        if spans[r.doc_id]:
            row["text"] = out + r.text[at:]
            row["n_chars"] = len(row["text"])
        want[tuple(row.values())] += 1
    got = W.redacted(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert Counter(map(tuple, got.collect())) == want
