"""Personal data: plain patterns against the contract's own, the graph against plain dictionaries."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from helpers import LONG, documents, no_documents

from stargauge.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


AWKWARD = [
    "", "a@b", "a@b.c", "a@b.c@d.e", "@b.c@d.e", "x a.b%c+d-e@h-h.i-j.k. y", "a@b..c", "a@.b.c d@e.f",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "01.002.0255.000", "256.1.1.1 1.1.1.256", "1.2.3", "1.2.3.4.", ".1.2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "4111  1111 1111 1111",
    "41111111111111114111111111111111", "+1 (743) 555-3824", "+1 555", "+12 (((((((", "++1 743 555 3824 99",
    "+1 (743) 555-3824 4078918989542222", "٣٤٥٦٧٨٩٠١٢٣٤٥٦", "ü@ö.de é.a@b.de", "a\x00b@c.d 1.2.3.4\n+49 30 1234567-8",
]


@pytest.mark.parametrize("text", AWKWARD)
def test_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_plain_patterns_on_random_texts():
    noise = random.Random(8)
    for _ in range(3000):
        text = "".join(noise.choices("0123459aA.@+-_ ()%\né", k=noise.randint(0, 60)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 150_000, "1 " * 150_000):
        assert pii.found_in(text) is not None


def digest(spans):
    told = ",".join(f"{pii.KINDS[kind]}:{start}:{end}" for start, kind, end in spans)
    return hashlib.sha256(told.encode()).hexdigest()


def test_every_awkward_row(spark):
    rows = [(i, text) for i, text in enumerate(AWKWARD)] + [(None, None), (None, "a@b.c"), (7, "a@b.c"), (99, LONG)]
    found = pii.personal_data(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    got = collections.Counter(
        (r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found
    )
    want = collections.Counter()
    for key, text in rows:
        spans = plain(text or "")
        want[(key, *(sum(k == kind for _, k, _ in spans) for kind in range(4)), digest(spans))] += 1
    assert got == want


def test_no_rows(spark):
    assert pii.personal_data(no_documents(spark)).collect() == []


# ---- bootstrapping ------------------------------------------------------------------------


def by_dictionaries(texts, rounds=3, least=3, promoted=0.7):
    """The method on one machine: what each text has beyond its seeds."""
    found = [pii.found_in(text)[1] for text in texts]
    edges = {(p, v, k): False for rows in found for k, _, _, _, v, ps in rows for p in ps}
    for rows in found:
        for kind, _, _, base, value, patterns in rows:
            for p in patterns:
                edges[p, value, kind] |= base
    total = collections.defaultdict(set)
    for p, v, _ in edges:
        total[p].add(v)
    seeds = {(v, k) for (_, v, k), seed in edges.items() if seed}
    known = {v for v, _ in seeds}
    score = {pair: pii.UNIT for pair in seeds}
    gained = {}
    for _ in range(rounds):
        mass = collections.Counter()
        for p, v, k in edges:
            mass[p, k] += score.get((v, k), 0)
        strong = {
            (p, k): m // (len(total[p]) + 1)
            for (p, k), m in mass.items() if m >= least * pii.UNIT and len(total[p]) >= least
        }
        sides = collections.defaultdict(lambda: [0, 0])
        for (p, v, k), seed in edges.items():
            if not seed and v not in known and (p, k) in strong:
                at = sides[v, k]
                side = p.startswith("_ ")
                at[side] = max(at[side], strong[p, k])
        best = {}
        for (v, k), (before, after) in sides.items():
            value = pii.UNIT - (pii.UNIT - before) * (pii.UNIT - after) // pii.UNIT
            best[v] = max(best.get(v, (0, "")), (value, k))
        gained = {(v, k): s for v, (s, k) in best.items() if s >= int(promoted * pii.UNIT)}
        score = {pair: pii.UNIT for pair in seeds} | gained
    return [
        sorted((start, end, kind) for kind, start, end, base, v, _ in rows if not base and (v, kind) in gained)
        for rows in found
    ]


def contextual():
    """Numbers after words that announce them, in their usual form and in others."""
    noise = random.Random(3)
    digits = lambda n: "".join(noise.choices("0123456789", k=n))
    rows = []
    for _ in range(14):
        rows.append(f"please call me on +1 {digits(3)} {digits(3)} {digits(4)} until noon today")
        rows.append(f"she writes to {noise.choice('abcdef')}{digits(3)}@mail.example.com from time to time")
    rows.append("please call me on 743 555 3824 until noon today")
    rows.append("but fax it over to 743 555 3824 or else")
    rows.append("she writes to anna [at] example [dot] com from time to time")
    # Words that announce nothing: what follows them is of all sorts.
    for _ in range(10):
        rows.append(f"the number the {digits(8)} was seen on the list")
        rows.append(f"the address the {digits(2)}.{digits(2)}.{digits(2)}.{digits(2)} was seen on the list")
    rows.append("a clean text with 1999 - 2004 and 12:30 and version 1.2.3 and no one's data")
    return rows


def test_patterns_find_what_no_plain_pattern_accepts(spark):
    texts = contextual()
    found = {r["doc_id"]: r for r in pii.personal_data(documents(spark, list(enumerate(texts)))).collect()}
    expected = by_dictionaries(texts)
    for i, text in enumerate(texts):
        told = sorted(
            [(start, pii.KINDS[kind], end) for start, kind, end in plain(text)]
            + [(start, kind, end) for start, end, kind in expected[i]],
            key=lambda s: (s[0], pii.KINDS.index(s[1])),
        )
        assert found[i]["spans"] == ",".join(f"{kind}:{start}:{end}" for start, kind, end in told)
    by_text = {texts[i]: row["spans"] for i, row in found.items()}
    assert by_text["please call me on 743 555 3824 until noon today"] == "phone:18:30"
    # Once known, an identifier is one everywhere.
    assert by_text["but fax it over to 743 555 3824 or else"] == "phone:19:31"
    assert by_text["she writes to anna [at] example [dot] com from time to time"] == "email:14:41"
    assert all(not spans for text, spans in by_text.items() if text.startswith(("the number", "a clean")))


def test_a_hot_value_weighs_once(spark):
    """Copies of one text are one instance, however many there are."""
    copies = ["dial this +1 555 010 9999 now please"] * 300 + ["dial this 555 010 1234 now please"]
    found = pii.personal_data(documents(spark, [(None, text) for text in copies])).collect()
    assert sum(row["n_phone"] for row in found) == 300
    assert {row["spans"] for row in found} == {"phone:10:25", ""}
    assert by_dictionaries(copies)[-1] == []
