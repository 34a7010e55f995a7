"""Personal data by a semi-Markov conditional random field (operator 13).

Fixed patterns find base spans of four kinds, which always stay: e-mail addresses, IPv4
addresses, card numbers with a right check digit, phone numbers in international form. They miss
what fails as one greedy match: two cards in a row, a card after another number, phone numbers
without a plus, addresses written with ``[at]`` and ``(dot)``. The model looks at zones, the
stretches of text that digits, separators and at signs run through, with one character on either
side. A zone is a row of atoms (a run of digits, a run of letters, one other character); a
segment is some atoms with a kind, or one atom that is outside. Features describe the whole
segment: its digits and groups, its check digit, its octets, what it is glued to. Dynamic
programming over segments of at most ``MOST_ATOMS`` atoms chooses boundaries and kinds together,
base spans being fixed, and spans that overlap no base span are added.

Weights are fitted by likelihood, with gradients from the forward and backward sums, on zones made
from at most ``sample`` different base spans (a documented bound): as they stand, and rewritten
into forms whose right answer is known by construction, together with look-alikes that are none.
A few spans written below are always among them, so that a corpus without personal data gets a
model too.

Text is read once; zones and base spans go to the shared folder, from which the sample is taken
and which is decoded. Zones of more than ``PIECE`` atoms are decoded in pieces that overlap by
more than the longest segment, and a span counts in the piece that it begins in.

Defined cases: a null text is empty and has no spans; places are code points; ids may be null or
repeat, each row is told; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import named
from fleetlens.session import checkpointed

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(1, 5)
SAMPLE = 200
STEPS, RATE, L2 = 120, 0.15, 1e-3
MOST_ATOMS = 24
PIECE, OVERLAP = 4096, 2 * MOST_ATOMS
#: Zones decoded together, and segments whose features are held at once.
BATCH, HELD = 256, 1 << 15

#: Spans that every model learns from.
SEEDS = [
    (EMAIL, "first.last@example.com"), (EMAIL, "a7@mail.example.org"), (IP, "192.0.2.17"), (IP, "203.0.113.9"),
    (CARD, "4111111111111111"), (CARD, "5500005555555559"), (PHONE, "+1 (555) 555-0100"), (PHONE, "+44 20 7946 0958"),
]

Span = tuple[int, int, int]

# ---------------------------------------------------------------- base spans

_LOCAL = "A-Za-z0-9._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BEFORE = re.compile(rf"[{_LOCAL}]+")
# a match starts at the start of its digits, so that long numbers are not tried at every digit
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORTH = re.compile(r"[0-9@]|[\[(]at[\])]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has one at sign, the local part before it and as much of a domain as there is."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL_BEFORE.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    if not _WORTH.search(text):
        return []
    found = [(EMAIL, *place) for place in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if len(m.group()) < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


# ---------------------------------------------------------------- zones and atoms

_NUMBERS = re.compile(r"[0-9+(][0-9 ().+-]*")
_ADDRESS_END = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)*")
_AT = re.compile(r"@|[\[(]at[\])]")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[\[(](?:at|dot)[\])]|[^0-9A-Za-z]")
_LEAST_DIGITS, _MOST_DIGITS = 7, 19
DIGITS, LETTERS, SPACE, DOT, DASH, PLUS, OPEN, CLOSE, AT, AT_WORD, DOT_WORD, LOCAL, OTHER = range(13)
_SINGLE = {" ": SPACE, ".": DOT, "-": DASH, "+": PLUS, "(": OPEN, ")": CLOSE, "@": AT, "_": LOCAL, "%": LOCAL}


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold a span, without overlaps, each with a character on either side."""
    if not _WORTH.search(text):
        return []
    found = []
    for m in _NUMBERS.finditer(text):
        if len(m.group()) >= _LEAST_DIGITS and len(_NOT_DIGIT.sub("", m.group())) >= _LEAST_DIGITS:
            found.append((m.start(), m.end()))
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        if start > free and text[start - 1] == " " and m.group() != "@":
            start -= 1
        while start > free and _LOCAL_BEFORE.match(text[start - 1]):
            start -= 1
        after = _ADDRESS_END.match(text, m.end())
        if after and start < m.start():
            found.append((start, after.end()))
            free = m.end()
    merged: list[tuple[int, int]] = []
    for start, end in sorted((max(0, s - 1), min(len(text), e + 1)) for s, e in found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _atom_class(atom: str) -> int:
    if "0" <= atom[0] <= "9":
        return DIGITS
    if len(atom) > 1 and atom[0] in "[(":
        return AT_WORD if atom[1] == "a" else DOT_WORD
    if atom[0].isascii() and atom[0].isalpha():
        return LETTERS
    return _SINGLE.get(atom, OTHER)


class Lattice:
    """Atoms of some zones one after another, and every segment that may be an entity.

    Node k stands before atom k; each zone ends with a closing atom that no segment covers, so
    that zones share no node. ``edges``: start node, end node, kind, with ``fixed`` marking base spans.
    """

    def __init__(self, texts: list[str], base: list[list[Span]]):
        kinds, sizes, places, first, digits, value, owner = [], [], [], [], [], [], []
        for z, text in enumerate(texts):
            first.append(len(kinds))
            for m in _ATOM.finditer(text):
                atom, kind = m.group(), _atom_class(m.group())
                kinds.append(kind)
                sizes.append(len(atom))
                places.append(m.start())
                owner.append(z)
                digits.append(atom if kind == DIGITS else "")
                value.append(int(atom) <= 255 if kind == DIGITS and len(atom) <= 3 else False)
            kinds.append(-1)
            sizes.append(0)
            places.append(len(text))
            owner.append(z)
            digits.append("")
            value.append(False)
        self.first = np.array([*first, len(kinds)], np.int64)
        self.kind, self.size, self.place = np.array(kinds, np.int64), np.array(sizes, np.int64), np.array(places, np.int64)
        self.owner, octet = np.array(owner, np.int64), np.array(value, bool)
        self.step = np.arange(len(kinds)) - self.first[self.owner] if kinds else np.empty(0, np.int64)
        self._flat = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - 48
        is_digits = self.kind == DIGITS
        self._n_digits = self._sums(np.where(is_digits, self.size, 0))
        doubled = np.where(self._flat < 5, self._flat * 2, self._flat * 2 - 9)
        even = np.arange(len(self._flat)) % 2 == 0
        self._plain_even = self._sums(np.where(even, self._flat, doubled))
        self._plain_odd = self._sums(np.where(even, doubled, self._flat))
        self._count = {k: self._sums(self.kind == k) for k in range(13)}
        self._octets = self._sums(octet)
        self._fours = self._sums(is_digits & (self.size == 4))
        single_gap = (self.kind == SPACE) | (self.kind == DASH) | (self.kind == DOT) | (self.kind == OPEN) | (self.kind == CLOSE)
        pair = np.zeros(len(kinds), bool)
        pair[1:] = single_gap[1:] & single_gap[:-1]
        usual = np.zeros(len(kinds), bool)
        usual[1:] = ((self.kind[:-1] == CLOSE) & (self.kind[1:] == SPACE)) | ((self.kind[:-1] == SPACE) & (self.kind[1:] == OPEN))
        self._odd_pairs = self._sums(pair & ~usual)
        self._segments(base)

    @staticmethod
    def _sums(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values)]).astype(np.int64)

    def _within(self, sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sums[j] - sums[i]

    def _segments(self, base: list[list[Span]]) -> None:
        n, c, within = len(self.kind), self._count, self._within
        out: list[np.ndarray] = [np.empty((0, 3), np.int64)]
        starts_number = (self.kind == DIGITS) | (self.kind == PLUS) | (self.kind == OPEN)
        is_word = (self.kind == DIGITS) | (self.kind == LETTERS)
        number = self._sums(np.isin(self.kind, [DIGITS, SPACE, DOT, DASH, PLUS, OPEN, CLOSE]))
        address = self._sums(np.isin(self.kind, [DIGITS, LETTERS, DOT, DASH, PLUS, LOCAL, AT, AT_WORD, DOT_WORD, SPACE]))
        beside = np.zeros(n, bool)
        written = (self.kind == AT_WORD) | (self.kind == DOT_WORD)
        beside[1:] |= written[:-1]
        beside[:-1] |= written[1:]
        free_space = self._sums((self.kind == SPACE) & ~beside)
        for size in range(1, min(MOST_ATOMS, n) + 1):
            i = np.flatnonzero(starts_number[: n - size + 1] & (self.kind[size - 1 :] == DIGITS))
            j = i + size
            d = within(self._n_digits, i, j)
            ok = (within(number, i, j) == size) & (d >= 4) & (d <= _MOST_DIGITS) & (within(c[PLUS], i + 1, j) == 0)
            i, j, d = i[ok], j[ok], d[ok]
            plain = (self.kind[i] == DIGITS) & (within(c[CLOSE], i, j) == 0) & (within(c[OPEN], i, j) == 0)
            dotted = plain & (size == 7) & (within(c[DOT], i, j) == 3) & (within(c[DIGITS], i, j) == 4)
            for kind, fits in ((IP, dotted), (CARD, plain & (d >= 12)), (PHONE, (d >= _LEAST_DIGITS) & (d <= 15))):
                out.append(np.column_stack([i[fits], j[fits], np.full(fits.sum(), kind)]))
            i = np.flatnonzero(is_word[: n - size + 1] & is_word[size - 1 :])
            j = i + size
            ats = within(c[AT], i, j) + within(c[AT_WORD], i, j)
            ok = (ats == 1) & (within(address, i, j) == size) & (within(free_space, i, j) == 0)
            out.append(np.column_stack([i[ok], j[ok], np.full(ok.sum(), EMAIL)]))
        entities = np.concatenate(out)
        fixed_rows, covered = [], np.zeros(n, bool)
        for z, spans in enumerate(base):
            own = slice(self.first[z], self.first[z + 1])
            for kind, start, end in spans:
                a, b = self.first[z] + np.searchsorted(self.place[own], [start, end])
                fixed_rows.append((a, b, kind))
                covered[a:b] = True
        fixed = np.array(fixed_rows, np.int64).reshape(-1, 3)
        entities = entities[within(self._sums(covered), entities[:, 0], entities[:, 1]) == 0]
        outside = np.flatnonzero(self.kind >= 0)
        outside = np.column_stack([outside, outside + 1, np.zeros(len(outside), np.int64)])
        edges = np.concatenate([outside, entities, fixed])
        is_fixed = np.arange(len(edges)) >= len(edges) - len(fixed)
        order = np.argsort(self.step[edges[:, 1]], kind="stable")
        self.edges, self.fixed = edges[order], is_fixed[order]

    def features(self, i: np.ndarray, j: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """One row of numbers for each segment, whatever its kind."""
        c, within, n = self._count, self._within, len(self.kind)
        d = within(self._n_digits, i, j)
        begin, stop = self._n_digits[i], self._n_digits[j]
        total = np.where((stop - 1) % 2 == 0, within(self._plain_even, begin, stop), within(self._plain_odd, begin, stop))
        groups = within(c[DIGITS], i, j)
        inner = self.owner[np.minimum(i, n - 1)]
        left = np.where(i > self.first[inner], self.kind[np.maximum(i - 1, 0)], OTHER)
        left2 = np.where(i > self.first[inner] + 1, self.kind[np.maximum(i - 2, 0)], OTHER)
        right = self.kind[np.minimum(j, n - 1)]
        right2 = np.where(right >= 0, self.kind[np.minimum(j + 1, n - 1)], OTHER)
        joint = [SPACE, DOT, DASH]
        opens, closes = within(c[OPEN], i, j), within(c[CLOSE], i, j)
        octets, ends = within(self._octets, i, j), self.size[np.maximum(j - 1, 0)]
        third = np.where(j - i >= 3, self.size[np.maximum(j - 3, 0)] * (self.kind[np.maximum(j - 3, 0)] == DIGITS), 0)
        lead = self._flat[np.minimum(begin, max(len(self._flat) - 1, 0))] if len(self._flat) else np.zeros(len(i), np.int64)
        dotted = (j - i == 7) & (within(c[DOT], i, j) == 3) & (groups == 4)
        local = [LETTERS, DIGITS, DOT, DASH, PLUS, LOCAL, AT]
        rows = [
            np.ones(len(i)), self.kind[i] == PLUS, self.kind[i] == OPEN, (total % 10 == 0) & (d >= 12), (total % 10 != 0) & (d >= 12),
            d == 16, d > 16, (d >= 13) & (d <= 15), d == 12, (d == 10) | (d == 11), (d >= 7) & (d <= 9),
            groups == 1, within(c[SPACE], i, j) > 0, within(c[DASH], i, j) > 0, within(c[DOT], i, j) > 0,
            (opens == 1) & (closes == 1), opens != closes, within(self._odd_pairs, i, j) > 0,
            (groups > 1) & (within(self._fours, i, j) == groups), ends == 4, (third == 3) & (ends == 4), groups >= 6,
            dotted & (octets == 4), dotted & (octets < 4), (lead >= 3) & (lead <= 6), lead == 0,
            left == LETTERS, (left == DIGITS) | (np.isin(left, joint) & (left2 == DIGITS)), (left == PLUS) | (left == OPEN),
            right == LETTERS, (right == DIGITS) | (np.isin(right, joint) & (right2 == DIGITS)), right == CLOSE,
            within(c[AT], i, j) > 0, within(c[AT_WORD], i, j) > 0,
            within(c[DOT], i, j) + within(c[DOT_WORD], i, j) > 0, (self.kind[np.maximum(j - 1, 0)] == LETTERS) & (ends >= 2) & (ends <= 6),
            np.isin(left, local), np.isin(right, [LETTERS, DIGITS, AT, AT_WORD, DOT_WORD]) | ((right == DOT) & np.isin(right2, [LETTERS, DIGITS])),
            (right == DOT_WORD) | ((right == SPACE) & (right2 == DOT_WORD)),
            (within(c[SPACE], i, j) > 0).astype(int) + (within(c[DASH], i, j) > 0) + (within(c[DOT], i, j) > 0) >= 2,
        ]
        out = np.column_stack(rows).astype(float)
        # an atom outside is told by its class only
        outside = kind == 0
        out[outside] = 0
        return out


N_FEATURES = 40


@dataclass
class Model:
    """Weights of kind by feature (row 0, outside, is unused), and of kind after kind."""

    weights: np.ndarray
    after: np.ndarray

    @classmethod
    def zero(cls) -> Model:
        return cls(np.zeros((5, N_FEATURES)), np.zeros((5, 5)))

    def scores(self, lattice: Lattice) -> np.ndarray:
        edges = lattice.edges
        out = np.zeros(len(edges))
        entity = np.flatnonzero(edges[:, 2] > 0)
        for k in range(0, len(entity), HELD):
            own = entity[k : k + HELD]
            i, j, kind = edges[own].T
            out[own] = (lattice.features(i, j, kind) * self.weights[kind]).sum(1)
        out[lattice.fixed] += 1e6
        return out

    def decode(self, lattice: Lattice) -> list[list[Span]]:
        """The best segmentation of each zone, as (kind, start, end) in characters of the zone."""
        edges, scores = lattice.edges, self.scores(lattice)
        best = np.full((len(lattice.kind), 5), -np.inf)
        best[lattice.first[:-1], 0] = 0.0
        edge_of, label_of = np.full(best.shape, -1), np.zeros(best.shape, np.int64)
        for a, b in _steps(lattice):
            i, j, kind = edges[a:b].T
            ahead = best[i] + self.after.T[kind]
            label = ahead.argmax(1)
            value = ahead[np.arange(b - a), label] + scores[a:b]
            order = np.lexsort((value, kind, j))
            last = np.flatnonzero(np.append((np.diff(j[order]) != 0) | (np.diff(kind[order]) != 0), True))
            at = order[last]
            best[j[at], kind[at]], edge_of[j[at], kind[at]], label_of[j[at], kind[at]] = value[at], a + at, label[at]
        out = []
        for first, node in zip(lattice.first[:-1].tolist(), (lattice.first[1:] - 1).tolist()):
            label, spans = int(best[node].argmax()), []
            while node > first:
                i, j, kind = edges[edge_of[node, label]].tolist()
                if kind:
                    spans.append((kind, int(lattice.place[i]), int(lattice.place[j - 1] + lattice.size[j - 1])))
                node, label = i, int(label_of[node, label])
            out.append(spans[::-1])
        return out


def _steps(lattice: Lattice) -> list[tuple[int, int]]:
    """Ranges of edges that end at the same distance from the start of their zone."""
    ends = lattice.step[lattice.edges[:, 1]]
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(ends)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _log_sums(model: Model, lattice: Lattice, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums by node and kind, and the log sum of each zone."""
    edges, steps = lattice.edges, _steps(lattice)
    ahead, behind = (np.full((len(lattice.kind), 5), -np.inf) for _ in range(2))
    ahead[lattice.first[:-1], 0] = 0.0
    behind[lattice.first[1:] - 1] = 0.0
    for a, b in steps:
        i, j, kind = edges[a:b].T
        np.logaddexp.at(ahead, (j, kind), np.logaddexp.reduce(ahead[i] + model.after.T[kind], axis=1) + scores[a:b])
    # backwards by the place of the start: edges that start later come first
    order = np.argsort(-lattice.step[edges[:, 0]], kind="stable")
    starts = lattice.step[edges[order, 0]]
    cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        own = order[a:b]
        i, j, kind = edges[own].T
        value = (behind[j, kind] + scores[own])[:, None] + model.after.T[kind]
        np.logaddexp.at(behind, (np.repeat(i, 5), np.tile(np.arange(5), b - a)), value.ravel())
    total = np.logaddexp.reduce(ahead[lattice.first[1:] - 1], axis=1)
    return ahead, behind, total


def fit(examples: list[tuple[str, list[Span]]], steps: int = STEPS) -> Model:
    """The likeliest weights for zones with their right spans, with an L2 penalty, by Adam."""
    lattice = Lattice([t for t, _ in examples], [[] for _ in examples])
    edges = lattice.edges
    i, j, kind = edges.T
    entity = kind > 0
    values = np.zeros((len(edges), N_FEATURES))
    values[entity] = lattice.features(i[entity], j[entity], kind[entity])
    truth = np.zeros(len(edges), bool)
    key = {tuple(e): k for k, e in enumerate(edges.tolist())}
    right_after = np.zeros((5, 5))
    for z, (_, spans) in enumerate(examples):
        first, last = int(lattice.first[z]), int(lattice.first[z + 1])
        node, label = first, 0
        for k, start, end in [*sorted(spans, key=lambda s: s[1]), (0, None, None)]:
            a = last - 1 if start is None else first + int(np.searchsorted(lattice.place[first:last], start))
            while node < a:
                truth[key[node, node + 1, 0]] = True
                right_after[label, 0] += 1
                node, label = node + 1, 0
            if k:
                b = first + int(np.searchsorted(lattice.place[first:last], end))
                truth[key[a, b, k]] = True
                right_after[label, k] += 1
                node, label = b, k
    model, n = Model.zero(), len(examples)
    right = np.zeros((5, N_FEATURES))
    np.add.at(right, kind[truth], values[truth])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.weights, model.after)]
    for step in range(1, steps + 1):
        scores = (values * model.weights[kind]).sum(1)
        ahead, behind, total = _log_sums(model, lattice, scores)
        rest = scores + behind[j, kind] - total[lattice.owner[i]]
        odds = np.exp(np.clip(ahead[i] + model.after.T[kind] + rest[:, None], -700, 0))
        expected, expected_after = np.zeros_like(right), np.zeros((5, 5))
        np.add.at(expected, kind, values * odds.sum(1)[:, None])
        np.add.at(expected_after.T, kind, odds)
        slopes = [(expected - right) / n + L2 * model.weights, (expected_after - right_after) / n + L2 * model.after]
        for parameter, slope, (one, two) in zip((model.weights, model.after), slopes, moments):
            one += 0.1 * (slope - one)
            two += 0.001 * (slope**2 - two)
            parameter -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return model


# ---------------------------------------------------------------- examples


def _joined(draw: random.Random, parts: list[tuple[int, str]]) -> tuple[str, list[Span]]:
    """Parts one after another, those with a kind being spans, between two characters of context."""
    before, after = draw.choice([" ", "\n", ",", ":", "#", "é"]), draw.choice([" ", "\n", ",", ";", "!", "#", "é"])
    text, spans = before, []
    for kind, part in parts:
        if kind:
            spans.append((kind, len(text), len(text) + len(part)))
        text += part
    return text + after, spans


def _grouped(digits: str, gap: str) -> str:
    return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))


def rewritten(kind: int, said: str, draw: random.Random) -> Iterator[tuple[str, list[Span]]]:
    """Other ways to write a span and its neighbourhood, and look-alikes that are no personal data."""
    number = str(draw.randrange(10 ** draw.randint(1, 6)))
    digits = _NOT_DIGIT.sub("", said)
    yield _joined(draw, [(kind, said)])
    if kind == EMAIL and said.count("@") == 1:
        name, host = said.split("@")
        for at, dot in (("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) ")):
            written = f"{name}{at}{host.replace('.', dot)}"
            if len(_ATOM.findall(written)) <= MOST_ATOMS and name[:1].isalnum() and name.isascii():
                yield _joined(draw, [(EMAIL, written)])
        yield _joined(draw, [(0, f"{name}@{host.split('.')[0]}")])
        yield _joined(draw, [(0, f"{name} (at) home")])
    elif kind == IP:
        parts = said.split(".")
        yield _joined(draw, [(0, ".".join([str(256 + draw.randrange(700)), *parts[1:]]))])
        yield _joined(draw, [(0, ".".join([*parts[:2], str(300 + draw.randrange(600)), parts[3]]))])
        yield _joined(draw, [(IP, said), (0, " "), (0, number)])
    elif kind == CARD and 13 <= len(digits) <= 19:
        gap, other = draw.choice(["", "", " ", "-"]), _grouped(digits, " ")
        yield _joined(draw, [(CARD, digits), (0, draw.choice([" ", "-"])), (CARD, digits)])
        yield _joined(draw, [(CARD, other), (0, "  "), (CARD, _grouped(digits, gap))])
        yield _joined(draw, [(0, number[:2]), (0, " "), (CARD, digits)])
        yield _joined(draw, [(CARD, digits), (0, " "), (0, number[:3])])
        yield _joined(draw, [(CARD, _grouped(digits, "."))])
        wrong = digits[:-1] + str((int(digits[-1]) + draw.randint(1, 9)) % 10)
        yield _joined(draw, [(0, wrong)])
        yield _joined(draw, [(0, _grouped(wrong, draw.choice([" ", "-"])))])
        yield _joined(draw, [(0, f"{digits[0]}.{digits[1]} {digits[2]}.{digits[3]} {digits[4]}.{digits[5:7]} {digits[7:10]} {digits[10:]}")])
        yield _joined(draw, [(0, digits[: draw.randint(8, 12)])])
        yield _joined(draw, [(0, f"a{digits[:12]}f")])
        yield _joined(draw, [(0, f"{digits[:8]}.{digits[8:]}")])
    elif kind == PHONE and len(digits) >= 10:
        area, middle, end = digits[-10:-7], digits[-7:-4], digits[-4:]
        for written in (f"({area}) {middle}-{end}", f"{area}-{middle}-{end}", f"({area}) {middle} {end}", f"00 1 {area} {middle} {end}"):
            yield _joined(draw, [(PHONE, written)])
        yield _joined(draw, [(PHONE, said), (0, draw.choice([" ", ", "])), (PHONE, said)])
        yield _joined(draw, [(0, number[:2]), (0, " "), (PHONE, f"({area}) {middle}-{end}")])
        yield _joined(draw, [(0, digits[-10:])])
        yield _joined(draw, [(0, f"20{digits[:2]}-0{draw.randint(1, 9)}-{draw.randint(10, 28)} {draw.randint(10, 23)}")])
        yield _joined(draw, [(0, f"{digits[:2]} {digits[2:4]} {digits[4:6]} {digits[6:8]} {digits[8:10]}")])


def examples(seen: Iterable[tuple[int, str]]) -> list[tuple[str, list[Span]]]:
    """Zones with their right spans, made from different spans; the same ones make the same zones."""
    out = []
    for kind, said in sorted({*SEEDS, *seen}):
        if len(_ATOM.findall(said)) <= MOST_ATOMS:
            draw = random.Random(zlib.crc32(said.encode()))
            out += rewritten(kind, said, draw)
    return _learnable(out)


def _learnable(made: list[tuple[str, list[Span]]]) -> list[tuple[str, list[Span]]]:
    """The zones whose right spans are among the segments of their lattice."""
    lattice = Lattice([text for text, _ in made], [[] for _ in made])
    edges = set(map(tuple, lattice.edges.tolist()))

    def node(z: int, place: int) -> int:
        first, last = lattice.first[z : z + 2]
        return int(first + np.searchsorted(lattice.place[first:last], place))

    return [e for z, e in enumerate(made) if all((node(z, s), node(z, t), k) in edges for k, s, t in e[1])]


# ---------------------------------------------------------------- tables

_SPANS = "array<struct<kind:int,start:bigint,stop:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
_ZONES = "array<struct<place:bigint,said:string>>"
_ZONE_TYPE = pa.list_(pa.struct([("place", pa.int64()), ("said", pa.string())]))


def _as_structs(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "stop": e} for k, s, e in spans]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, zones) of every row, stored in the shared folder; the only pass over the texts."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, held = [], []
            for value in batch.column(1):
                said = value.as_py() or ""
                base.append(_as_structs(base_spans(said)))
                held.append([{"place": s, "said": said[s:e]} for s, e in zones(said)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _SPAN_TYPE), pa.array(held, _ZONE_TYPE)], ["doc_id", "base", "zones"]
            )

    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    return checkpointed(own.mapInArrow(found, f"doc_id {id_type}, base {_SPANS}, zones {_ZONES}"))


def train(scanned: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` different base spans, those of the lowest hashes of each kind, and the fixed ones."""

    def said(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts = [], []
            for base, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for zone in held or ():
                    for span in base or ():
                        start, stop = span["start"] - zone["place"], span["stop"] - zone["place"]
                        if start >= 0 and stop <= len(zone["said"]) and stop - start <= 64:
                            kinds.append(span["kind"])
                            texts.append(zone["said"][start:stop])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], ["kind", "said"])

    spans = scanned.filter(F.size("base") > 0).select("base", "zones").mapInArrow(said, "kind int, said string").distinct()
    ranked = spans.select("kind", "said", F.xxhash64("said").alias("at"))
    # an equal share for each kind, each a top-k over the hash: never more than ``sample`` rows
    shares = [ranked.filter(F.col("kind") == k).orderBy("at", "said").limit(sample // 4) for k in range(1, 5)]
    chosen = shares[0].unionAll(shares[1]).unionAll(shares[2]).unionAll(shares[3]).collect()
    return fit(examples((r["kind"], r["said"]) for r in chosen))


def _pieces(said: str) -> Iterator[tuple[int, str, int, int]]:
    """(place, text, from, to) of a zone's pieces; spans that begin in [from, to) of the piece count."""
    if len(said) <= PIECE:
        yield 0, said, 0, len(said) + 1
        return
    ends = [m.end() for m in _ATOM.finditer(said)]
    starts = [0, *ends]
    for k in range(0, len(ends), PIECE):
        a, b = max(0, k - OVERLAP), min(len(ends), k + PIECE + OVERLAP)
        last = min(len(ends), k + PIECE)
        yield starts[a], said[starts[a] : starts[b]], starts[k] - starts[a], starts[last] - starts[a]


def find(scanned: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans, each sorted by kind and start."""

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = [[(s["kind"], s["start"], s["stop"]) for s in own or ()] for own in batch.column(1).to_pylist()]
            every = [set(own) for own in bases]
            work = []
            for row, held in enumerate(batch.column(2).to_pylist()):
                for zone in held or ():
                    for at, said, low, high in _pieces(zone["said"]):
                        work.append((row, zone["place"] + at, said, low, high))
            for k in range(0, len(work), BATCH):
                part = work[k : k + BATCH]
                inside = [
                    [(kind, s - at, e - at) for kind, s, e in bases[row] if at <= s and e <= at + len(said)] for row, at, said, _, _ in part
                ]
                for (row, at, _, low, high), spans in zip(part, model.decode(Lattice([p[2] for p in part], inside))):
                    every[row].update((kind, at + s, at + e) for kind, s, e in spans if low <= s < high)
            out = [sorted(_compatible(found, set(own))) for found, own in zip(every, bases)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([_as_structs(b) for b in bases], _SPAN_TYPE), pa.array([_as_structs(s) for s in out], _SPAN_TYPE)
                ],
                ["doc_id", "base", "spans"],
            )

    id_type = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(decoded, f"doc_id {id_type}, base {_SPANS}, spans {_SPANS}")


def _compatible(found: set[Span], base: set[Span]) -> Iterator[Span]:
    """Base spans, and in order of place the others that overlap neither these nor an earlier one."""
    yield from base
    taken = sorted((s, e) for _, s, e in base)
    free = at = 0
    furthest = 0
    for kind, start, end in sorted(found - base, key=lambda s: (s[1], s[2], s[0])):
        while at < len(taken) and taken[at][0] < end:
            furthest = max(furthest, taken[at][1])
            at += 1
        if start >= free and start >= furthest:
            yield kind, start, end
            free = end


def told(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of ``find``'s rows; numbers count base spans."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def joined(column: str):
        each = F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(each, ",")

    def counted(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [counted(k).alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digest(spans: Iterable[Span]) -> str:
    """What ``told`` says of base spans, for one text."""
    said = ",".join(f"{KINDS[k - 1]}:{s}:{e}" for k, s, e in spans)
    return hashlib.sha256(said.encode()).hexdigest()
