"""PII: fixed base patterns, and a semi-Markov conditional random field for what they miss.

Base spans come from the contract's patterns, matched without quadratic scans. Around
digits and spelled-out at signs, zones of tokens are cut; within a zone every run of at
most TOKENS tokens that begins and ends like an entity is a candidate segment. Whole-span
features (digit groups, separators, checksum, neighbours) score a segment for each type;
a token outside scores 0. Dynamic programming over the zone picks the best segmentation:
boundaries and types jointly. Since no candidate lies outside a zone, this is the best
segmentation of the whole text. The weights maximise the conditional log-likelihood
(forward-backward over segments, AdaGrad, fixed seed) of generated sentences with known
spans and with look-alikes: dates, prices, versions, serial numbers.

Base spans stay; a segment that overlaps one is dropped.

Defined results: null and empty texts have no spans; base_sha256 is then that of the empty
string. Of equal scores the segmentation with fewer segments, then earlier ones, wins. A
text of any length is scanned whole; an entity is found however long its words are.
Repeated rows each give a row. Nothing but id and text columns is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")
TOKENS, DIGITS, GROUPS = 16, 19, 6  # of a segment, at most
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMERIC = re.compile(r"[+(]?[0-9][0-9+().\[\]\x20/-]*+")
SPELLED = re.compile(r"(?i)[\[({]\x20?at\x20?[\])}]|\x20at\x20(?=[A-Za-z0-9-]++\x20(?:dot|\.)\x20)")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]|\s+")
CUES = {"phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "amex": "card", "ip": "ip", "host": "ip", "server": "ip", "mail": "email", "email": "email", "contact": "email", "order": "id", "no": "id", "isbn": "id", "id": "id", "version": "id", "serial": "id"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((0, a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _kind(c: str) -> int:
    """Which class of TOKEN a character is in."""
    return 0 if c.isascii() and c.isalpha() else 1 if "0" <= c <= "9" else 2 if c.isspace() else 3


def _around(text: str, start: int, end: int) -> tuple[int, int]:
    """The part with TOKENS tokens on either side: no candidate that holds start:end reaches further."""
    a = start
    for _ in range(TOKENS):
        if not a:
            break
        kind, a = _kind(text[a - 1]), a - 1
        while kind < 3 and a and _kind(text[a - 1]) == kind:
            a -= 1
    z = end
    for _, m in zip(range(TOKENS), TOKEN.finditer(text, end)):
        z = m.end()
    return a, z


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text that may hold an entity, in order, apart from each other."""
    found = []
    if DIGIT.search(text):
        found = [m.span() for m in NUMERIC.finditer(text) if len(m[0]) >= 7 and sum(c in "0123456789" for c in m[0]) >= 4]
    found += [_around(text, *m.span()) for m in SPELLED.finditer(text)]
    found.sort()
    held = None
    for a, z in found:
        if held and a <= held[1]:
            held = (held[0], max(held[1], z))
        else:
            if held:
                yield held
            held = (a, z)
    if held:
        yield held


def _candidates(text: str, a: int, z: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Tokens of a zone, and candidate segments (first, past the last, kind)."""
    tokens = [m.span() for m in TOKEN.finditer(text, a, z)]
    out = []
    for i, (s, e) in enumerate(tokens):
        c = text[s]
        alone = s == 0 or text[s - 1] not in LOCAL
        if c in "0123456789" or c in "+(" and i + 1 < len(tokens) and text[tokens[i + 1][0]] in "0123456789":
            digits = groups = 0
            for j in range(i, min(len(tokens), i + TOKENS)):
                s2, e2 = tokens[j]
                if "0" <= text[s2] <= "9":
                    digits, groups = digits + e2 - s2, groups + 1
                    if digits > DIGITS or groups > GROUPS:
                        break
                    if groups == 4 and digits <= 12 and "." in text[s:s2]:
                        out.append((i, j + 1, 1))
                    if digits >= 13:
                        out.append((i, j + 1, 2))
                    if 7 <= digits <= 15:
                        out.append((i, j + 1, 3))
                elif text[s2] not in "().[]-/ +" or text[s2] == "+" and j > i:
                    break
        if alone and (c.isascii() and c.isalnum()):
            at = False
            for j in range(i, min(len(tokens), i + TOKENS)):
                word = text[tokens[j][0] : tokens[j][1]].lower()
                at = at or word in ("at", "@")
                if at and word.isalpha() and word.isascii() and j > i + 2 and (j + 1 == len(tokens) or text[tokens[j][1]] not in LOCAL - {"."}):
                    out.append((i, j + 1, 0))
    return tokens, out


def _features(kind: int, text: str, s: int, e: int) -> list[tuple]:
    span = text[s:e]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    before = re.findall(r"[A-Za-z]+", text[max(0, s - 24) : s])
    cue = CUES.get(before[-1].lower(), "") if before else ""
    left, right = text[s - 1 : s], text[e : e + 1]
    if kind == 0:
        at, dot = bool(re.search(r"(?i)[\[({]\x20?at\x20?[\])}]", span)), bool(re.search(r"(?i)[\[({ ]dot[\])} ]|\.", span))
        words = re.sub(r"(?i)[\[({]?\x20?\b(at|dot)\b\x20?[\])}]?", " ", span).split()
        f = ["bias", f"at{at}", f"dot{dot}", f"dots{at and dot}", f"words{min(6, len(words))}", f"top{len(span) - len(span.rstrip(ascii_letters))}", f"cue{cue}", f"spaces{min(5, span.count(' '))}", f"ends{dot and bool(re.search(r'(?i)(dot[\])}]?|[.])\x20?[a-z]{2,4}$', span))}"]
    else:
        seps = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
        f = ["bias", f"n{len(digits)}", f"seps{seps}", f"groups{','.join(str(len(g)) for g in groups)}", f"count{len(groups)}", f"first{span[0] if not span[0].isdigit() else 'd'}", f"cue{cue}", f"right{'d' if right.isdigit() else 'a' if right.isalnum() else right}", f"left{'d' if left.isdigit() else 'a' if left.isalnum() else left}", f"zero{digits[:2] == '00'}"]
        if kind == 1:
            f.append(f"bytes{len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)}")
        if kind == 2:
            f.append(f"luhn{13 <= len(digits) <= 19 and luhn(digits)}")
        if kind == 3:
            f.append(f"year{bool(re.search(r'(?:19|20)[0-9]{2}', span)) and len(digits) <= 8}")
    return [(kind, x) for x in f]


def _scored(text: str, a: int, z: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, list]]]:
    tokens, found = _candidates(text, a, z)
    return tokens, [(i, j, k, _features(k, text, tokens[i][0], tokens[j - 1][1])) for i, j, k in found]


def decode(text: str, a: int, z: int, weights: dict) -> list[tuple[int, int, int]]:
    """The best segmentation of a zone: (kind, start, end)."""
    tokens, segments = _scored(text, a, z)
    by_end: dict[int, list] = {}
    for i, j, k, f in segments:
        s = sum(weights.get(x, 0.0) for x in f)
        if s > 0:
            by_end.setdefault(j, []).append((i, k, s))
    best, back = [0.0], [None]
    for j in range(1, len(tokens) + 1):
        top, how = best[j - 1], None
        for i, k, s in by_end.get(j, ()):
            if best[i] + s > top:
                top, how = best[i] + s, (i, k)
        best.append(top)
        back.append(how)
    out, j = [], len(tokens)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((k, tokens[i][0], tokens[j - 1][1]))
            j = i
    return out[::-1]


def generated(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with their spans (kind, start, end): entities that the base patterns miss or find, and look-alikes."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    lead = lambda k: str(rng.integers(2, 10)) + digits(k - 1)
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick("an", "er", "in", "st", "lo", "ma", "ti", "o", "u", "e") for _ in range(rng.integers(1, 4)))

    def checked(k: int) -> str:
        body = pick("4", "5", "37", "6011")
        body += digits(k - 1 - len(body))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def email() -> str:
        at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), ("{at}", "{dot}"))
        return word() + pick("", ".", "_") + word() + at + word() + dot + pick("com", "org", "net", "de", "io")

    def phone() -> str:
        a, b, c = lead(3), lead(3), digits(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"00 {lead(2)} {digits(2)} {digits(7)}", f"0{lead(3)} {digits(6)}", f"0{lead(2)}/{digits(7)}", f"+{lead(2)} {digits(3)} {digits(7)}")

    def card() -> str:
        x, y = checked(16), checked(15)
        fours = [x[i : i + 4] for i in range(0, 16, 4)]
        return pick(f"{y[:4]} {y[4:10]} {y[10:]}", f"{y[:4]}-{y[4:10]}-{y[10:]}", ".".join(fours), " ".join(fours), "-".join(fours), x, y)

    def ip() -> str:
        p = [str(v) for v in rng.integers(0, 256, 4)]
        return pick("[.]".join(p), " . ".join(p), "(.)".join(p), ".".join(p))

    def other() -> str:
        y = str(rng.integers(1900, 2100))
        return pick(f"{y}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(10, 29)}/{rng.integers(10, 13)}/{y}", f"{y}-{rng.integers(1900, 2100)}", digits(16), digits(12), digits(8), f"1.{digits(1)}.{digits(2)}.{digits(1)}.{digits(3)}", f"3.{digits(9)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", " ".join(digits(1) for _ in range(9)), f"{digits(5)} {digits(5)}", f"{digits(2)}.{digits(2)}.{y}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"({y}) {digits(2)}-{digits(2)}", word() + " at " + word() + " " + word(), word() + " (at) " + word())

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(word() for _ in range(rng.integers(1, 5))) + " "
            k = int(rng.integers(0, 8))
            if k < 4:
                cue = pick("", "", ("contact: ", "host ", "card ", "call ")[k])
                body = (email, ip, card, phone)[k]()
                text += cue
                spans.append((k, len(text), len(text) + len(body)))
                text += body
            else:
                text += pick("", "", "order ", "no. ", "serial ") + other()
            text += pick(" ", ", ", ". ")
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 500, epochs: int = 6, seed: int = 11) -> dict:
    """Weights by maximum conditional likelihood over segmentations, with a small ridge."""
    data = []
    for text, spans in generated(n, seed):
        for a, z in zones(text):
            tokens, segments = _scored(text, a, z)
            gold = {(k, s, e) for k, s, e in spans}
            data.append((len(tokens), [(i, j, f, (k, tokens[i][0], tokens[j - 1][1]) in gold) for i, j, k, f in segments]))
    weights, square = {}, {}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for d in rng.permutation(len(data)):
            n_tokens, segments = data[d]
            if not segments:
                continue
            s = [sum(weights.get(x, 0.0) for x in f) for _, _, f, _ in segments]
            ends, starts = {}, {}
            for q, (i, j, _, _) in enumerate(segments):
                ends.setdefault(j, []).append(q)
                starts.setdefault(i, []).append(q)
            fore, aft = np.zeros(n_tokens + 1), np.zeros(n_tokens + 1)
            for j in range(1, n_tokens + 1):
                fore[j] = np.logaddexp.reduce([fore[j - 1]] + [fore[segments[q][0]] + s[q] for q in ends.get(j, ())])
            for i in range(n_tokens - 1, -1, -1):
                aft[i] = np.logaddexp.reduce([aft[i + 1]] + [aft[segments[q][1]] + s[q] for q in starts.get(i, ())])
            grad: dict = {}
            for q, (i, j, f, true) in enumerate(segments):
                g = true - np.exp(fore[i] + s[q] + aft[j] - fore[-1])
                if abs(g) > 1e-4:
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + g
            for x, g in grad.items():
                g -= 1e-3 * weights.get(x, 0.0)
                square[x] = square.get(x, 0.0) + g * g
                weights[x] = weights.get(x, 0.0) + 0.5 * g / np.sqrt(square[x] + 1e-8)
    return {k: float(v) for k, v in sorted(weights.items())}


def spans(text: str, weights: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, by kind, then start."""
    base = base_spans(text)
    more = [x for a, z in zones(text) for x in decode(text, a, z, weights)]
    if more and base:
        starts = sorted((s, e) for _, s, e in base)
        at = [s for s, _ in starts]
        tops = np.maximum.accumulate([e for _, e in starts])
        k = np.searchsorted(at, [e for _, _, e in more])  # base spans that start before the segment ends
        more = [x for x, n in zip(more, k.tolist()) if n == 0 or tops[n - 1] <= x[1]]
    return base, sorted(base + more)


def _shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of docs."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                base, every = spans(text.as_py() or "", weights.value)
                counts = [0, 0, 0, 0]
                for k, _, _ in base:
                    counts[k] += 1
                out.append((i, *counts, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
