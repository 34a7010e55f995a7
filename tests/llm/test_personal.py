import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from fleetlens.llm import personal
from fleetlens.llm.personal import CARD, EMAIL, IP, PHONE

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text: str) -> list:
    out = []
    for kind, pattern in enumerate(PATTERNS, 1):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                EMAIL: True, IP: kind == IP and all(int(p) <= 255 for p in m.group().split(".")),
                CARD: 16 <= len(digits) <= 19 and luhn(digits), PHONE: 8 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def model():
    return personal.fit(personal.examples([]))


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(0)
    pieces = ["a", "é", "@", ".", "-", " ", "1", "25", "255", "+", "(", ")", "x.y", "@b.c", "4111111111111111", "+1 555 0100 99", "\n", "%"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(24)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_whole_table_by_brute_force(spark, documents):
    scanned = personal.scan(documents)
    found = personal.find(scanned, personal.train(scanned))
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in personal.told(found).collect():
        base = plain_spans(texts[r["doc_id"]])
        said = [f"{personal.KINDS[k - 1]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() == personal.digest(base)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for k, _, _ in base) for kind in range(1, 5)]
        every = r["spans"].split(",") if r["spans"] else []
        assert set(said) <= set(every) and len(set(every)) == len(every)
        keys = [(personal.KINDS.index(k), int(s), int(e)) for k, s, e in (v.split(":") for v in every)]
        assert keys == sorted(keys)


def segmentations(lattice, node: int, last: int):
    if node == last:
        yield []
    for e in np.flatnonzero(lattice.edges[:, 0] == node):
        for rest in segmentations(lattice, int(lattice.edges[e, 1]), last):
            yield [int(e), *rest]


def test_dynamic_programming_by_enumeration():
    draw = np.random.default_rng(0)
    texts = [" 12 34 567 8 ", "a1@b.c", "1.2.3.4 55", "(555) 123 4567", ""]
    lattice = personal.Lattice(texts, [[] for _ in texts])
    model = personal.Model(draw.normal(size=(5, personal.N_FEATURES)), draw.normal(size=(5, 5)))
    scores = model.scores(lattice)
    _, _, total = personal._log_sums(model, lattice, scores)
    for z, spans in enumerate(model.decode(lattice)):
        values = {}
        for path in segmentations(lattice, int(lattice.first[z]), int(lattice.first[z + 1]) - 1):
            kinds = [0, *(int(lattice.edges[e, 2]) for e in path)]
            value = sum(scores[e] for e in path) + sum(model.after[a, b] for a, b in itertools.pairwise(kinds))
            values[tuple(path)] = value
        assert total[z] == pytest.approx(np.logaddexp.reduce(list(values.values())))
        best = max(values, key=values.get)
        assert spans == [
            (int(k), int(lattice.place[i]), int(lattice.place[j - 1] + lattice.size[j - 1])) for i, j, k in lattice.edges[list(best)] if k
        ]


def decoded(model, text: str) -> list:
    return [s for a, b in personal.zones(text) for s in [(k, a + s, a + e) for k, s, e in model.decode(personal.Lattice([text[a:b]], [[]]))[0]]]


def test_adds_what_the_patterns_miss(model):
    cases = {
        "pay 4465758382889437 4465758382889437 now": [CARD, CARD], "no 12 4111 1111 1111 1111 x": [CARD], "ring (663) 555-6869, please": [PHONE],
        "ring 663-555-6869": [PHONE], "bob.k [at] site [dot] org": [EMAIL], "bob(at)site.org": [EMAIL], "from 10.20.30.40 on": [IP],
    }
    for text, kinds in cases.items():
        assert [s[0] for s in decoded(model, text)] == kinds, text


def test_leaves_look_alikes_alone(model):
    for text in (
        "order 1234567890 of 2024-01-02 10:11:12", "card? 4111111111111112", "10.20.30.400", "commit f61083db5dbd7654321df2369d",
        "me@home and @handle", "values 3.14159265 2.71828182", "look at the dot", "(at) work", "12 34 56 78 90",
    ):
        assert decoded(model, text) == [], text


def test_held_out_rewritings(model):
    draw = random.Random(9)
    seen = []
    for _ in range(60):
        digits = "4" + "".join(draw.choice("0123456789") for _ in range(14))
        seen.append((CARD, next(digits + c for c in "0123456789" if luhn(digits + c))))
        seen.append((PHONE, f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(10000):04d}"))
        seen.append((IP, ".".join(str(draw.randrange(256)) for _ in range(4))))
        seen.append((EMAIL, f"user.{draw.randrange(100)}@mail{draw.randrange(10)}.example.com"))
    known = personal.examples([])
    cases = [e for e in personal.examples(seen) if e not in known]
    found = model.decode(personal.Lattice([t for t, _ in cases], [[] for _ in cases]))
    right = sum(f == spans for f, (_, spans) in zip(found, cases))
    assert right >= 0.95 * len(cases)


def test_odd_rows(spark, odd_docs, no_docs, model):
    scanned = personal.scan(no_docs)
    assert personal.told(personal.find(scanned, personal.train(scanned))).count() == 0
    scanned = personal.scan(odd_docs)
    assert personal.find(scanned, model).count() == odd_docs.count()
    assert all(r["spans"] == "" for r in personal.told(personal.find(scanned, model)).filter("doc_id IS NULL").collect())


def test_long_zones_are_decoded_in_pieces(spark, model, monkeypatch):
    monkeypatch.setattr(personal, "PIECE", 64)
    monkeypatch.setattr(personal, "OVERLAP", 48)
    text = " ".join(["4465758382889437 12", "77 123", "(663) 555-6869"] * 60)
    docs = spark.createDataFrame([(1, text), (2, "9 " * 5000), (3, "1" * 30_000 + " @" * 3000)], "doc_id int, text string")
    rows = {r["doc_id"]: r["spans"] for r in personal.find(personal.scan(docs), model).collect()}
    kinds = [s["kind"] for s in sorted(rows[1], key=lambda s: s["start"])]
    assert kinds == [CARD, PHONE] * 60 and rows[2] == rows[3] == []


def test_clashing_columns_and_hot_rows(spark, model):
    docs = spark.createDataFrame(
        [(None if i % 3 == 0 else i, "é mail a@b.co twice a@b.co", "x", [1]) for i in range(90)],
        "doc_id bigint, text string, base string, zones array<int>",
    )
    rows = personal.told(personal.find(personal.scan(docs), model)).collect()
    assert len(rows) == 90 and {(r["n_email"], r["spans"]) for r in rows} == {(2, "email:7:13,email:20:26")}
