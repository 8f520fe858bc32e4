"""Personal data: exact patterns, and a linear-chain conditional random field for what they miss.

Patterns find emails, IPv4 addresses, payment cards and international phone numbers, each
kind leftmost and non-overlapping. The random field labels tokens (runs without white
space) as outside, or as the beginning or inside of one of the kinds. Its features are word
shapes (letters as a or A, runs of digits by length, other characters as they are) of the
token and its neighbours, and words beside them. It is trained from a small labelled table
of at most MAX_LABELLED lines, on the driver, since that bound is a parameter.

An anchor is a token with a digit, one of @ + ( [ or the word "dot". A token further than
REACH from every anchor has the one label "outside", which belongs to the model, in
training as in decoding. So a text is cut exactly into short chains around its anchors:
numpy finds the anchors of a slice of texts in its bytes, and Viterbi runs on all chains of
a slice together, a step for each place. What the field proposes must hold as its kind
(checksum, number of digits, address), and gives way to any pattern's span that it overlaps.

Cost: one pass over the text without a shuffle; a task holds a slice of SLICE bytes, or one
text if that is longer. All patterns take time linear in the text.

Defined cases: null and empty texts have no spans; repeated rows, null ids and ties are rows
of their own; very long texts are taken whole; an empty table gives an empty result; other
columns pass through, but for one named `spans`, which is replaced. An empty labelled table
adds nothing to the patterns.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, packed

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
SLICE, REACH, MAX_LABELLED = 1 << 23, 3, 5000
#: 0 is outside; then beginning and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
RESTS = np.array([[(y % 2 == 1 or y == 0) or x in (y - 1, y) for y in range(LABELS)] for x in range(LABELS)])

_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_HERE, EMAIL_NEXT = re.compile(_EMAIL), re.compile(rf"(?<!{_LOCAL}){_EMAIL}")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := EMAIL_HERE.match(text, at) or EMAIL_NEXT.search(text, at):
        yield m.span()
        at = m.end()  # what is left of a run of letters may begin the next one


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the exact patterns, by start and then by kind."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.groups()):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# Tokens, anchors and chains

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[[*range(48, 58), *b"@+(["]] = 2


@dataclass
class Chains:
    """Tokens around anchors: their bytes' bounds, and where each chain begins and ends among them."""

    first: np.ndarray  # first byte of each token
    last: np.ndarray  # behind its last byte
    bounds: np.ndarray  # chains' bounds among the tokens
    text: np.ndarray  # text of each chain
    hot: np.ndarray  # which texts have an anchor


def chains(raw: np.ndarray, offsets: np.ndarray) -> Chains:
    """Chains of the texts raw[offsets[k]:offsets[k + 1]]."""
    kind = _CLASS[raw]
    solid = kind != 1
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    starts[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    dot = np.flatnonzero(last - first == 3)
    dot = dot[(raw[first[dot]] | 32) == ord("d")]
    dot = dot[((raw[first[dot] + 1] | 32) == ord("o")) & ((raw[first[dot] + 2] | 32) == ord("t"))]
    anchors = np.union1d(np.searchsorted(first, np.flatnonzero(kind == 2), "right") - 1, dot)
    text = np.searchsorted(offsets, first[anchors], "right") - 1
    own = np.searchsorted(first, offsets)  # tokens before each text
    near = (anchors[:, None] + np.arange(-REACH, REACH + 1)).ravel()
    of = np.repeat(text, 2 * REACH + 1)
    near = np.unique(near[(near >= own[of]) & (near < own[of + 1])])
    of = np.searchsorted(own, near, "right") - 1
    cut = np.flatnonzero((np.diff(near) > 1) | (np.diff(of) > 0)) + 1
    bounds = np.concatenate(([0], cut, [len(near)])) if len(near) else np.zeros(1, np.int64)
    return Chains(first[near], last[near], bounds, of[bounds[:-1]], np.unique(text))


# Features

_EDGE = "\"'<>{}.,;:!?"


@lru_cache(1 << 16)
def shape(token: str) -> str:
    """The token's shape, at most 24 characters: edges off, letters and digit runs folded."""
    bare = token.strip(_EDGE)
    if len(bare) > 64:
        return "long"
    out = re.sub(r"[0-9]+", lambda m: f"\x00{len(m[0]) if len(m[0]) < 5 else '5' if len(m[0]) < 7 else '7' if len(m[0]) < 10 else 'x' if len(m[0]) < 13 else 'c' if len(m[0]) < 20 else 'z'}", bare)
    out = re.sub(r"[^\W\d_]+", lambda m: ("A" if m[0][0].isupper() else "a") + ("" if len(m[0]) > 1 else "1"), out)
    return out.replace("\x00", "d")[:24]


@lru_cache(1 << 16)
def word(token: str) -> str:
    """A word of letters in lower case, else nothing."""
    bare = token.strip(_EDGE + "()[]").lower()
    return bare if bare.isalpha() and len(bare) <= 12 else ""


@lru_cache(1 << 16)
def _own(token: str) -> tuple[str, ...]:
    out = [f"s={shape(token)}", f"w={word(token)}"]
    bare = token.strip(_EDGE)
    digits = sum("0" <= c <= "9" for c in bare[:64])
    out.append(f"n={min(digits, 20)}{any(c.isalpha() for c in bare[:64])}")
    if "@" in bare:
        out.append(f"@={bool(re.fullmatch(r'[^@]+@[^@.]+(?:[.][^@.]+)+', bare[:256]))}")
    if bare.count(":") > 1:
        out.append(f":={bool(re.fullmatch(r'[0-9A-Fa-f:]+', bare[:64]))}")
    if token[-1:] in _EDGE:
        out.append(f"e={token[-1:]}")
    return tuple(out)


def features(tokens: list[str]) -> list[list[str]]:
    """The features of each token of a chain; places beyond its ends are plain text."""
    padded = ["", "", *tokens, "", ""]
    out = []
    for k in range(2, len(padded) - 2):
        before, here, after = padded[k - 1], padded[k], padded[k + 1]
        found = ["1", *_own(here), f"p={shape(before)}", f"q={shape(after)}", f"pw={word(before)}", f"qw={word(after)}"]
        found += [f"ps={shape(before)} {shape(here)}", f"qs={shape(here)} {shape(after)}", f"ppw={word(padded[k - 2])}", f"pp={shape(padded[k - 2])}", f"qq={shape(padded[k + 2])}"]
        out.append(found)
    return out


# The random field

@dataclass
class Field:
    names: dict[str, int]
    weights: np.ndarray  # features x labels; the last row is of features not seen
    moves: np.ndarray  # label before x label

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        ids = np.array([self.names.get(f, -1) for row in rows for f in row], np.int64)
        sizes = np.array([len(row) for row in rows])
        if not len(sizes):
            return np.zeros((0, LABELS))
        return np.add.reduceat(self.weights[ids], np.concatenate(([0], np.cumsum(sizes)[:-1])))


def _padded(values: np.ndarray, bounds: np.ndarray, fill: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """values of chains as (longest, chains, ...), and the chains' lengths."""
    sizes = np.diff(bounds)
    out = np.full((int(sizes.max()), len(sizes), *values.shape[1:]), fill, values.dtype)
    chain = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(values)) - bounds[chain], chain] = values
    return out, sizes


def viterbi(emissions: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of chains between tokens that are outside; chains of like length run together."""
    out, sizes = np.zeros(len(emissions), np.int64), np.diff(bounds)
    allowed = np.where(RESTS, moves, -np.inf)
    order, k = np.argsort(sizes, kind="stable"), 0
    while k < len(order):
        j = k + 1
        while j < len(order) and (j - k + 1) * sizes[order[j]] <= 1 << 18 and sizes[order[j]] <= 2 * sizes[order[k]] + 8:
            j += 1
        which = order[k:j]
        places = np.concatenate([np.arange(bounds[c], bounds[c + 1]) for c in which])
        padded, n = _padded(emissions[places], np.concatenate(([0], np.cumsum(sizes[which]))))
        best, back = padded[0] + allowed[0], np.zeros((len(padded), len(which), LABELS), np.int8)
        for t in range(1, len(padded)):
            score = best[:, :, None] + allowed
            back[t] = score.argmax(1)
            best = np.where((t < n)[:, None], score.max(1) + padded[t], best)
        label = (best + allowed[:, 0]).argmax(1)
        for t in range(len(padded) - 1, -1, -1):
            live = t < n
            out[bounds[which[live]] + t] = label[live]
            label = np.where(live, back[t][np.arange(len(which)), label], label)
        k = j
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def likelihood(emissions: np.ndarray, bounds: np.ndarray, moves: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels, and its gradients by emissions and by moves."""
    allowed = np.where(RESTS, moves, -np.inf)
    padded, n = _padded(emissions, bounds)
    steps, many, _ = padded.shape
    ahead, behind = np.empty_like(padded), np.empty_like(padded)
    ahead[0] = padded[0] + allowed[0]
    for t in range(1, steps):
        ahead[t] = np.where((t < n)[:, None], _log_sum(ahead[t - 1][:, :, None] + allowed, 1) + padded[t], ahead[t - 1])
    close = np.broadcast_to(allowed[:, 0], (many, LABELS))
    behind[-1] = close
    for t in range(steps - 2, -1, -1):
        behind[t] = np.where((t + 1 < n)[:, None], _log_sum(allowed[None] + (padded[t + 1] + behind[t + 1])[:, None, :], 2), close)
    total = _log_sum(ahead[-1] + close, 1)
    live = np.arange(steps)[:, None] < n
    share = np.exp(ahead + behind - total[None, :, None]) * live[:, :, None]
    chain = np.repeat(np.arange(many), n)
    place = np.arange(len(emissions)) - bounds[chain]
    by_emission = -share[place, chain]
    by_emission[np.arange(len(labels)), labels] += 1
    by_move = np.zeros((LABELS, LABELS))
    for t in range(1, steps):
        on = t < n
        if on.any():
            by_move -= np.exp(ahead[t - 1][on][:, :, None] + allowed[None] + (padded[t] + behind[t])[on][:, None, :] - total[on][:, None, None]).sum(0)
    by_move[0] -= share[0].sum(0)
    by_move[:, 0] -= share[n - 1, np.arange(many)].sum(0)
    heads, tails = bounds[:-1], bounds[1:] - 1
    inner = np.setdiff1d(np.arange(len(labels)), heads)
    score = emissions[np.arange(len(labels)), labels].sum() + moves[0, labels[heads]].sum() + moves[labels[tails], 0].sum() + moves[labels[inner - 1], labels[inner]].sum()
    np.add.at(by_move, (labels[inner - 1], labels[inner]), 1)
    np.add.at(by_move, (np.zeros(len(heads), np.int64), labels[heads]), 1)
    np.add.at(by_move, (labels[tails], np.zeros(len(tails), np.int64)), 1)
    return float(score - total.sum()), by_emission, np.where(RESTS, by_move, 0)


def _columns(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *(len(b) for b in blobs)], dtype=np.int64)


def _tokens(raw: np.ndarray, found: Chains) -> list[str]:
    return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(found.first.tolist(), found.last.tolist(), strict=True)]


def _rows(tokens: list[str], bounds: np.ndarray) -> list[list[str]]:
    return [row for a, b in zip(bounds[:-1], bounds[1:], strict=True) for row in features(tokens[a:b])]


def fit(labelled: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 40, rate: float = 0.3, decay: float = 0.5) -> Field:
    """The field of highest penalised likelihood for lines with spans (start, end, kind), by adaptive gradient steps."""
    texts = [t for t, _ in labelled]
    raw, offsets = _columns(texts)
    found = chains(raw, offsets)
    labels = np.zeros(len(found.first), np.int64)
    for chain, k in enumerate(found.text):
        # Spans as bytes of the text, to meet tokens.
        spans = [(len(texts[k][:a].encode()), len(texts[k][:b].encode()), 1 + 2 * KINDS.index(kind)) for a, b, kind in labelled[k][1]]
        for i in range(found.bounds[chain], found.bounds[chain + 1]):
            for a, b, label in spans:
                if found.first[i] - offsets[k] < b and a < found.last[i] - offsets[k]:
                    labels[i] = label + (found.first[i] - offsets[k] > a)
    rows = _rows(_tokens(raw, found), found.bounds)
    names: dict[str, int] = {}
    ids = np.array([names.setdefault(f, len(names)) for row in rows for f in row], np.int64)
    sizes = np.array([len(row) for row in rows], np.int64)
    field = Field(names, np.zeros((len(names) + 1, LABELS)), np.zeros((LABELS, LABELS)))
    if not len(rows):
        field.weights[:, 0] = 1
        return field
    heads, token = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(ids, kind="stable")
    cut = np.searchsorted(ids[order], np.arange(len(names)))
    seen = [np.full_like(field.weights, 1e-8), np.full_like(field.moves, 1e-8)]
    for _ in range(rounds):
        emissions = np.add.reduceat(field.weights[ids], heads)
        _, by_emission, by_move = likelihood(emissions, found.bounds, field.moves, labels)
        by_weight = np.zeros_like(field.weights)
        by_weight[:-1] = np.add.reduceat(by_emission[token[order]], cut)
        for value, step, scale in ((field.weights, by_weight, seen[0]), (field.moves, by_move, seen[1])):
            step -= decay * value
            scale += step**2
            value += rate * step / np.sqrt(scale)
    return field


# The labelled table

#: Lines of the default table: text with fillers in braces; a filler that is a kind is labelled.
LINES = (
    "Write to {email} today.", "Contact: {email} or {phone}", "mail {email} for it", "e-mail {email}, please", "It was {email} who wrote", "({email})",
    "Call {phone} now.", "Tel. {phone}", "phone: {phone}", "my number is {phone}, ask for me", "Fax {phone} Mail {email}", "reach us at {phone} or at the door",
    "Server {ip} is down", "from {ip} to {ip}", "host {ip}, port 80", "login from {ip} failed", "the address {ip} was seen",
    "card {card} was charged", "paid with {card}.", "Visa {card} exp 12/27", "number {card} on the bill", "credit card: {card}",
    "{phone} {card}", "{card} {phone} {ip}", "{email} {card}", "{ip} {phone} {email} {card}", "the {phone} {card} and {ip} {card}", "the {email} and the {phone} of it", "then {phone} and there {ip} for all", "le {phone} est ici", "die Nummer {phone} ist da", "el {email} es de la casa",
    "Version {no} of the software", "in {no} there were {no} of them", "section {no} (see {no})", "released on {date} under it", "the hash {hex} is known", "key = \"{hex}\"", "token={hex}",
    "Licensed under the Apache License, Version 2.0.", "it cost {no} at the shop (or {no})", "order {long} was sent", "id {long} and id {long}", "ISBN {no}-{no}-{no}", "meet at {time} at the dot on the map",
    "see (a) and (b) at the end [1]", "the dot is at the end of it", "look at that [sic] and (at last) go", "@user said that @other was @ home", "a + b (c) is + d", "AKIA{hex} is a key", "{no}% of {no} in {no}", "pages {no}-{no}, table {no}.{no}",
    "call it {no} or {no}", "number {no} of {no}", "card {no} of the deck", "{date} {time} {no}", "password={hex}", "at the dot", "{no}.{no} is a version", "C++ [{no}] (x)",
)
_WORDS = "anna ben carla dora emil frank gina hugo ida jan karl lena mara nils olga paul rosa sven tina uwe vera smith jones meyer garcia".split()
_DOMAINS = "example mail shop firma correo poste host net-works uni data".split()
_ENDS = "com org net de fr es io info".split()


def _filler(kind: str, r: random.Random) -> str:
    """A made-up value of one kind, in one of the ways people write it."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        name, place, end = f"{r.choice(_WORDS)}{r.choice(['', '.' + r.choice(_WORDS), d(2), '_' + r.choice(_WORDS)])}", r.choice(_DOMAINS), r.choice(_ENDS)
        plain = f"{name}@{place}.{end}"
        return r.choice([plain, plain, f"{name} (at) {place} (dot) {end}", f"{name} [at] {place} [dot] {end}", f"{name} at {place} dot {end}", f"{name}(at){place}.{end}", f"{name} [at] {place}.{end}", f"{name} @ {place}.{end}", f"jör{name}@bü{place}.{end}"])
    if kind == "phone":
        area, a, b = d(3), d(3), d(4)
        return r.choice([f"+1 ({area}) {a}-{b}", f"+49 {area} {d(7)}", f"+{d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"0{d(3)}/{d(7)}", f"0{d(2)} {d(7)}", f"00{d(2)} {d(3)} {d(7)}"])
    if kind == "ip":
        plain = ".".join(str(r.randrange(256)) for _ in range(4))
        return r.choice([plain, plain, f"{r.randrange(4096, 65536):x}:{r.randrange(16, 65536):x}::{r.randrange(1, 65536):x}", ":".join(f"{r.randrange(65536):x}" for _ in range(8))])
    if kind == "card":
        body = r.choice("45") + d(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice([full, *(s.join(full[k : k + 4] for k in range(0, 16, 4)) for s in " -./")])
    if kind == "hex":
        return "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(16, 41)))
    if kind == "date":
        return r.choice([f"{r.randrange(1950, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1950, 2030)}", f"{r.randrange(1, 13)}/{r.randrange(1, 29)}/{r.randrange(1950, 2030)}"])
    if kind == "time":
        return f"{r.randrange(24)}:{r.randrange(60):02}"
    if kind == "long":
        return d(r.randrange(6, 24))
    return r.choice([d(1), d(2), d(3), d(4), f"{d(1)}.{d(1)}", f"{d(2)}.{d(2)}", f"{d(1)},{d(3)}", f"{d(3)} {d(3)}"]).lstrip("0") or "7"


def default_labels(copies: int = 16, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The default labelled table: each line filled `copies` times, between words of plain text."""
    r, out = random.Random(seed), []
    for line in LINES * copies:
        text, spans = " ".join(r.choice(_WORDS) for _ in range(r.randrange(5))), []
        text += " " if text else ""
        for part in re.split(r"(\{\w+\})", line):
            if part.startswith("{"):
                value = _filler(part[1:-1], r)
                if part[1:-1] in KINDS:
                    spans.append((len(text), len(text) + len(value), part[1:-1]))
                text += value
            else:
                text += part
        out.append((text + "".join(" " + r.choice(_WORDS) for _ in range(r.randrange(5))), spans))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """(text, spans) of the default labelled lines."""
    rows = [(t, [(k, a, b) for a, b, k in s]) for t, s in default_labels()]
    return spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")


def train(labelled: DataFrame, most: int = MAX_LABELLED) -> Field:
    """A field from (text, spans); of a larger table, `most` lines by the hash of their text."""
    rows = labelled.where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return fit([(x["text"], [(s["start"], s["end"], s["kind"]) for s in x["spans"] or []]) for x in rows])


# Spans


def _holds(kind: str, value: str) -> bool:
    """Whether a value that the field proposes can be one of its kind."""
    digits = re.sub("[^0-9]", "", value[:256])
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        try:
            return bool(ipaddress.ip_address(value))
        except ValueError:
            return False
    return "@" in value or re.search(r"\bat\b", value, re.I) is not None


_OPEN, _SHUT = "\"'<>{}.,;:!?)]", "\"'<>{}.,;:!?(["


def _added(text: str, first: int, last: int, kind: int) -> tuple[int, int, int] | None:
    """The span without punctuation at its edges, if something is left."""
    while first < last and text[first] in (_OPEN if kind == 3 else _OPEN + "(["):
        first += 1
    while first < last and text[last - 1] in (_SHUT if text.count("(", first, last) >= text.count(")", first, last) > 0 else _SHUT + ")]"):
        last -= 1
    return (first, last, kind) if first < last and _holds(KINDS[kind], text[first:last]) else None


def spans_of(column: pa.Array, field: Field) -> list[list[dict]]:
    """The spans of each text: those of the patterns, and what the field adds."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, cuts, data = column.buffers()
    offsets = np.frombuffer(cuts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    found = chains(raw, offsets)
    out: list[list[dict]] = [[] for _ in range(len(column))]
    if not len(found.hot):
        return out
    tokens = _tokens(raw, found)
    labels = viterbi(field.emissions(_rows(tokens, found.bounds)), found.bounds, field.moves)
    begins = np.flatnonzero(labels % 2 == 1)
    chain = np.searchsorted(found.bounds, begins, "right") - 1
    guessed: dict[int, list[tuple[int, int, int]]] = {}
    for i, c in zip(begins.tolist(), chain.tolist(), strict=True):
        j = i + 1
        while j < found.bounds[c + 1] and labels[j] == labels[i] + 1:
            j += 1
        k = int(found.text[c])
        guessed.setdefault(k, []).append((int(found.first[i] - offsets[k]), int(found.last[j - 1] - offsets[k]), int(labels[i]) // 2))
    for k in found.hot.tolist():
        body = raw[offsets[k] : offsets[k + 1]].tobytes()
        text = body.decode("utf-8", "replace")
        base = patterns(text)
        added = []
        plain, at = len(body) == len(text), 0
        taken = sorted((a, b) for a, b, _ in base)
        before = at_byte = 0
        for first, last, kind in guessed.get(k, ()):
            if plain:
                a, b = first, last
            else:  # code points before the span, counted on from the one before
                before += len(body[at_byte:first].decode("utf-8", "replace"))
                at_byte = first
                a, b = before, before + len(body[first:last].decode("utf-8", "replace"))
            own = _added(text, a, b, kind)
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            near = taken[at : at + 64]
            if own and not any(x < own[1] and own[0] < y for x, y in near):
                added.append(own)
        out[k] = [{"kind": KINDS[kind], "start": a, "end": b, "base": is_base} for a, b, kind, is_base in sorted([*((*s, True) for s in base), *((*s, False) for s in added)], key=lambda s: (s[0], s[2]))]
    return out


def find(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """docs with `spans` of (kind, start, end, base) in code points, by start and then by kind."""
    spark = docs.sparkSession
    kept = docs.select(*(F.col(common.quoted(c)) for c in docs.columns if c.lower() != "spans"))
    sent = spark.sparkContext.broadcast(field or train(labelled_table(spark)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packed.sliced(batch, text, SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans_of(part.column(text), sent.value), kind)], [*part.schema.names, "spans"])
                packed.release()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("spans", T._parse_datatype_string(SPANS))]))


def redacted(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """docs with each found span of the text replaced by its kind in brackets; spans that overlap, by the first's."""
    spans, t = F.col("spans"), F.coalesce(F.col(common.quoted(text)), F.lit(""))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))
    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))))
    found = find(docs, text, field)
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(common.quoted(text)))).drop("spans")
