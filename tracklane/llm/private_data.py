"""Personal data: fixed patterns, and a semi-Markov conditional random field for other forms.

The patterns give the base spans. The field adds spans that do not overlap them: addresses
spelt out ("jo at example dot org"), phone numbers without a plus, grouped card numbers, account and
social security numbers.

A candidate segment is a stretch of at most ``GROUPS`` groups of digits, a spelt-out address with any of
its possible ends, or an account number; its features look at the whole segment (how many digits in which
groups, checksums, octets) and at what stands around it. Each kind has a weight per feature.
A segmentation of a text picks candidates that do not overlap; what lies between scores 0. Its probability is
proportional to the exponential of the scores it adds up. Training maximises the likelihood of the right
segmentation by sums over all of them, decoding takes the best one; both are
dynamic programmes over the ends of candidates, so a long text costs as much as its candidates.

No table marks spans, so the field is trained on ``SENTENCES`` sentences that are made here, from a fixed seed,
with the spans known: personal data in several forms, and dates, versions, prices, order and book
numbers beside them. The weights are a small table that goes with the code of the tasks.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm.common import pieces, ship, table, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")  # the order of spans
GROUPS = 8  # groups of digits in a segment
DIGITS = range(7, 20)  # digits of a segment
SENTENCES = 2000
STEPS = 100
RIDGE = 1e-3

Span = tuple[str, int, int]

# Base patterns --------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each at sign once: the local part reaches back to the last character that is none, or to the match before."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield "email", start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that do not overlap within a kind, failing ones dropped; by kind and start."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        # a part of leading zeros may be long; four characters after them exceed 255 anyway
        if all(len(part) <= 3 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = re.sub("[ -]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


# Candidate segments and their features ---------------------------------------------------------

_CHAIN = re.compile(r"[0-9]++(?:[ ().\-/+]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@| ?[(\[]at[)\]] ?| at (?=[A-Za-z0-9-]{1,63}(?: dot | ?[(\[]dot[)\]] ?|\.[A-Za-z]))", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_DOT = re.compile(r"(\.(?=[A-Za-z0-9])| dot (?=[A-Za-z])| ?[(\[]dot[)\]] ?(?=[A-Za-z]))", re.I)
_LABELS = 5
ENDINGS = frozenset("com org net edu gov info io de fr es it nl uk eu ch at".split())
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# words before a segment, by what they speak for
CUES = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "whatsapp", "ring", "text", "telefon", "teléfono"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "email": ("email", "mail", "contact", "write", "reach", "correo", "courriel"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "other": ("order", "invoice", "isbn", "version", "no", "id", "page", "vol", "ticket", "item", "ref", "serial", "build", "released", "on"),
}
_CUE_OF = {word: name for name, words in CUES.items() for word in words}
_WORD = re.compile(r"[^\W\d_]+")
SHAPES = ("3-2-4", "3-3-4", "3-4", "4-4-4-4", "4-6-5", "4-2-2", "2-2-4", "one")

NAMES = (
    [f"digits {n}" for n in DIGITS] + [f"shape {s}" for s in SHAPES] + [f"cue {c}" for c in CUES]
    + ["plus", "round", "other shape", "luhn", "not luhn", "octets", "not octets", "joined by -", "joined by .", "joined by blank", "joined by /", "joined by +"]
    + ["joined in two ways", "more before", "more after", "zero first", "money", "number sign", "decimal", "percent", "groups 5 or more"]
    + ["numbers", "address", "at sign", "at word", "at bracketed", "dot plain", "dot word", "dot bracketed", "last label short", "last label letters", "known ending"]
    + ["label follows", "digits in last label", "account", "mod 97", "not mod 97"]
)
_NUMBER = {name: k for k, name in enumerate(NAMES)}


class Candidate:
    __slots__ = ("start", "end", "features")

    def __init__(self, start: int, end: int, names: list[str]):
        self.start, self.end, self.features = start, end, [_NUMBER[n] for n in names]


def _cues(text: str, start: int) -> list[str]:
    words = _WORD.findall(text[max(0, start - 28) : start].lower())[-3:]
    return sorted({f"cue {_CUE_OF[w]}" for w in words if w in _CUE_OF})


def _number_candidates(text: str) -> Iterator[Candidate]:
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < DIGITS[0]:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, chain.start(), chain.end())]
        if chain.start() and (text[chain.start() - 1].isalnum() or text[chain.start() - 1] == "_"):
            groups = groups[1:]  # digits inside a word
        if groups and chain.end() < len(text) and (text[chain.end()].isalnum() or text[chain.end()] == "_"):
            groups = groups[:-1]
        for i in range(len(groups)):
            n = 0
            for j in range(i, min(i + GROUPS, len(groups))):
                n += groups[j][1] - groups[j][0]
                if n > DIGITS[-1]:
                    break
                if n >= DIGITS[0]:
                    yield _number_candidate(text, groups, i, j, n)


def _number_candidate(text: str, groups: list[tuple[int, int]], i: int, j: int, n: int) -> Candidate:
    start, end = groups[i][0], groups[j][1]
    while start and text[start - 1] in "+(" and groups[i][0] - start < 2:
        start -= 1
    whole = text[start:end]
    parts = [text[a:b] for a, b in groups[i : j + 1]]
    names = ["numbers", f"digits {n}", *_cues(text, start)]
    shape = "one" if len(parts) == 1 else "-".join(str(len(p)) for p in parts)
    names.append(f"shape {shape}" if shape in SHAPES else "other shape")
    between = {text[b:a] for (_, b), (a, _) in zip(groups[i:j], groups[i + 1 : j + 1])}
    for mark, name in (("-", "-"), (".", "."), (" ", "blank"), ("/", "/"), ("+", "+")):
        if any(mark in x for x in between):
            names.append(f"joined by {name}")
    names += ["joined in two ways"] if len(between) > 1 else []
    names += ["plus"] if "+" in whole[:2] else []
    names += ["round"] if "(" in whole else []
    if n >= 13:
        names.append("luhn" if luhn("".join(parts)) else "not luhn")
    if len(parts) == 4 and between == {"."}:
        names.append("octets" if all(int(p) <= 255 for p in parts) else "not octets")
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    names += ["more before"] if i and groups[i][0] - groups[i - 1][1] < 2 else []
    names += ["more after"] if j + 1 < len(groups) and groups[j + 1][0] - end < 2 else []
    names += ["zero first"] if parts[0][0] == "0" else []
    names += ["money"] if before.strip()[-1:] in ("$", "€", "£") else []
    names += ["number sign"] if before.endswith(("#", "=", ":")) else []
    names += ["decimal"] if after[:1] == "," or before[-1:] == "," else []
    names += ["percent"] if after.strip()[:1] == "%" else []
    names += ["groups 5 or more"] if len(parts) >= 5 else []
    return Candidate(start, end, names)


def _address_candidates(text: str) -> Iterator[Candidate]:
    for at in _AT.finditer(text):
        local = _BEFORE_AT.search(text, max(0, at.start() - 64), at.start())
        label = _LABEL.match(text, at.end())
        if not local or not label:
            continue
        form = at.group().strip().lower()
        names = ["address", "at sign" if form == "@" else "at word" if form == "at" else "at bracketed", *_cues(text, local.start())]
        dots = set()
        for _ in range(_LABELS):
            dot = _DOT.match(text, label.end())
            label = dot and _LABEL.match(text, dot.end())
            if not label:
                break
            mark = dot.group().strip().lower()
            dots.add("dot plain" if mark == "." else "dot word" if mark == "dot" else "dot bracketed")
            last = label.group()
            more = ["last label short"] if 2 <= len(last) <= 4 else []
            more += ["last label letters"] if last.isalpha() else ["digits in last label"]
            more += ["known ending"] if last.lower() in ENDINGS else []
            more += ["label follows"] if _DOT.match(text, label.end()) else []
            yield Candidate(local.start(), label.end(), [*names, *sorted(dots), *more])


def _account_candidates(text: str) -> Iterator[Candidate]:
    for m in _IBAN.finditer(text):
        packed = m.group().replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
        yield Candidate(*m.span(), ["account", "mod 97" if int(turned) % 97 == 1 else "not mod 97", *_cues(text, m.start())])


_HAS_DIGIT = re.compile("[0-9]")


def regions(text: str) -> list[list[Candidate]]:
    """Candidate segments, in groups that do not overlap each other."""
    found = list(_address_candidates(text))
    if _HAS_DIGIT.search(text):
        found += [*_number_candidates(text), *_account_candidates(text)]
    found.sort(key=lambda c: (c.start, c.end))
    out, reach = [], -1
    for c in found:
        if c.start >= reach:
            out.append([])
        out[-1].append(c)
        reach = max(reach, c.end)
    return out


# The field ---------------------------------------------------------------------------------


def lattice(candidates: list[Candidate]) -> tuple[list[int], list[int], int]:
    """Number of the boundary where each candidate starts and ends, and how many boundaries there are."""
    bounds = sorted({b for c in candidates for b in (c.start, c.end)})
    place = {b: k for k, b in enumerate(bounds)}
    return [place[c.start] for c in candidates], [place[c.end] for c in candidates], len(bounds)


def _logaddexp(a: float, b: float) -> float:
    top, low = (a, b) if a > b else (b, a)
    return top if low == -math.inf else top + math.log1p(math.exp(low - top))


def marginals(first: list[int], last: list[int], m: int, scores: list[float]) -> tuple[float, list[float]]:
    """Log of the sum over all segmentations, and the probability of each segment, forwards and backwards."""
    ending: list[list[int]] = [[] for _ in range(m)]
    starting: list[list[int]] = [[] for _ in range(m)]
    for k, (a, b) in enumerate(zip(first, last)):
        starting[a].append(k)
        ending[b].append(k)
    ahead, behind = [0.0] * m, [0.0] * m
    for b in range(1, m):
        total = ahead[b - 1]
        for k in ending[b]:
            total = _logaddexp(total, ahead[first[k]] + scores[k])
        ahead[b] = total
    for a in range(m - 2, -1, -1):
        total = behind[a + 1]
        for k in starting[a]:
            total = _logaddexp(total, behind[last[k]] + scores[k])
        behind[a] = total
    whole = ahead[m - 1]
    return whole, [math.exp(ahead[a] + s + behind[b] - whole) for a, b, s in zip(first, last, scores)]


def best(first: list[int], last: list[int], m: int, scores: list[float]) -> list[int]:
    """The segments of the segmentation with the highest score; of equal ones the one with fewer, earlier segments."""
    ending: list[list[int]] = [[] for _ in range(m)]
    for k, b in enumerate(last):
        ending[b].append(k)
    top, chosen = [0.0] * m, [-1] * m
    for b in range(1, m):
        top[b] = top[b - 1]
        for k in ending[b]:
            if top[first[k]] + scores[k] > top[b]:
                top[b], chosen[b] = top[first[k]] + scores[k], k
    out, b = [], m - 1
    while b > 0:
        k = chosen[b]
        if k >= 0:
            out.append(k)
        b = first[k] if k >= 0 else b - 1
    return out[::-1]


class Field:
    """Weights of kinds by features, trained on sentences with known spans."""

    def __init__(self, sentences: list[tuple[str, list[Span]]], steps: int = STEPS, ridge: float = RIDGE):
        self.weights = np.zeros((len(KINDS), len(NAMES)))
        lattices, rows, gold = [], [], []
        for text, spans in sentences:
            right = {(a, b): KINDS.index(kind) for kind, a, b in spans}
            for candidates in regions(text):
                lattices.append((len(rows), *lattice(candidates)))
                rows += [c.features for c in candidates]
                gold += [right.get((c.start, c.end), -1) for c in candidates]
        if not rows:
            return
        held = np.zeros((len(rows), len(NAMES)))
        for k, features in enumerate(rows):
            held[k, features] = 1
        target = np.zeros((len(rows), len(KINDS)))
        known = np.array(gold)
        target[np.flatnonzero(known >= 0), known[known >= 0]] = 1
        speed, pull = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            scores = held @ self.weights.T
            top = scores.max(axis=1)
            joint = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))  # over kinds
            expected = np.zeros(len(rows))
            flat = joint.tolist()
            for at, first, last, m in lattices:
                expected[at : at + len(first)] = marginals(first, last, m, flat[at : at + len(first)])[1]
            shares = np.exp(scores - joint[:, None]) * expected[:, None]
            slope = (target - shares).T @ held / len(lattices) - ridge * self.weights
            speed = 0.9 * speed + 0.1 * slope
            pull = 0.99 * pull + 0.01 * slope**2
            self.weights += 0.15 * (speed / (1 - 0.9**step)) / (np.sqrt(pull / (1 - 0.99**step)) + 1e-8)

    def spans(self, text: str) -> list[Span]:
        """The segments of the best segmentation of a text, by kind and start."""
        out = []
        for candidates in regions(text):
            scores = np.array([self.weights[:, c.features].sum(axis=1) for c in candidates])
            kinds = scores.argmax(axis=1)
            for k in best(*lattice(candidates), scores.max(axis=1).tolist()):
                out.append((KINDS[kinds[k]], candidates[k].start, candidates[k].end))
        return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


# Sentences to learn from -------------------------------------------------------------------------


def _digits(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def _with_check(draw: random.Random, n: int, good: bool = True) -> str:
    body = draw.choice("3456") + _digits(draw, n - 2)
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if good else str((int(check) + draw.randint(1, 9)) % 10))


def _grouped(text: str, sizes: list[int], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(text[at : at + n])
        at += n
    return mark.join(out)


def _account(draw: random.Random, good: bool = True) -> str:
    country, body = draw.choice(["DE", "FR", "GB", "ES", "NL", "IT"]), _digits(draw, draw.choice([14, 16, 18, 20, 23]))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    check = check if good else 2 + (check + draw.randint(1, 90)) % 97
    whole = f"{country}{check:02d}{body}"
    return whole if draw.random() < 0.5 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))


def _name(draw: random.Random) -> str:
    return "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(draw.randint(2, 9)))


def _address(draw: random.Random) -> str:
    at, dot = draw.choice([("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]")])
    labels = [_name(draw) for _ in range(draw.randint(1, 2))] + [draw.choice(["com", "org", "net", "de", "fr", "es", "info"])]
    return _name(draw) + draw.choice(["", ".", "_"]) + _name(draw) + at + dot.join(labels)


def _phone(draw: random.Random) -> str:
    a, b, c = _digits(draw, 3), _digits(draw, 3), _digits(draw, 4)
    forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{draw.randint(20, 99)} {a} {b} {c}", f"({a}) {b} {c}"]
    return draw.choice(forms)


def _octets(draw: random.Random) -> str:
    return ".".join(str(draw.randint(0, 255)) for _ in range(4))


def _card(draw: random.Random) -> str:
    if draw.random() < 0.3:
        return _grouped(_with_check(draw, 15), [4, 6, 5], draw.choice([" ", "-"]))
    return _grouped(_with_check(draw, 16), [16] if draw.random() < 0.4 else [4, 4, 4, 4], draw.choice([" ", "-"]))


def _social(draw: random.Random) -> str:
    return f"{_digits(draw, 3)}-{_digits(draw, 2)}-{_digits(draw, 4)}"


def _harmless(draw: random.Random) -> str:
    y, m, d = draw.randint(1950, 2030), draw.randint(1, 12), draw.randint(1, 28)
    return draw.choice(
        [
            f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d:02d}.{m:02d}.{y}", f"{y}{m:02d}{d:02d}{_digits(draw, 6)}",
            _digits(draw, draw.randint(7, 15)), f"{draw.randint(10, 40)}.0.{draw.randint(256, 99999)}.{draw.randint(0, 2000)}",
            f"978-3-{_digits(draw, 2)}-{_digits(draw, 6)}-{_digits(draw, 1)}", f"{_digits(draw, 3)}.{_digits(draw, 8)}",
            f"${_digits(draw, 8)}", f"{_digits(draw, 9)}%", _with_check(draw, 16, False), _grouped(_with_check(draw, 16, False), [4, 4, 4, 4], " "),
            _account(draw, False), f"look at {_name(draw)}.com", f"stay at {_name(draw)} dot", f"{_digits(draw, 4)}-{_digits(draw, 4)}",
            f"{y} {y + 1} {y + 2} {y + 3}", f"{_digits(draw, 5)} {_digits(draw, 5)} {_digits(draw, 5)}", f"{_digits(draw, 2)}:{_digits(draw, 2)}",
            f"{_digits(draw, 3)}/{_digits(draw, 3)}/{_digits(draw, 4)}", f"{_name(draw)}@{_name(draw)}", f"{_digits(draw, 4)} {_digits(draw, 6)} {_digits(draw, 2)}",
        ]
    )


_MAKERS = {"email": _address, "ip": _octets, "card": _card, "phone": _phone, "iban": _account, "ssn": _social}


def sentences(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Made sentences with their spans: about half of what they name is personal data."""
    draw, out = random.Random(seed), []
    for _ in range(count):
        text, spans = "", []
        for _ in range(draw.randint(1, 3)):
            text += "".join(_name(draw) + " " for _ in range(draw.randint(1, 4)))
            if draw.random() < 0.5:
                kind = draw.choice(KINDS)
                text += draw.choice(["", "", draw.choice(CUES[kind]) + draw.choice([" ", ": "])])
                made = _MAKERS[kind](draw)
                spans.append((kind, len(text), len(text) + len(made)))
            else:
                text += draw.choice(["", "", draw.choice(CUES["other"]) + " "])
                made = _harmless(draw)
            text += made + draw.choice([" ", ". ", ", ", "\n", " and "])
        out.append((text + _name(draw), spans))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field(sentences(SENTENCES, seed=20240117))


# Over a table ----------------------------------------------------------------------------------------


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with the field's that overlap none of them; each by kind and start."""
    base = base_spans(text)
    taken: list[list[int]] = []  # what base spans cover, as stretches apart from each other
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    more = []
    for kind, a, b in field.spans(text):
        k = bisect_left(starts, b)  # the last stretch that starts before the end of the span
        if not k or taken[k - 1][1] <= a:
            more.append((kind, a, b))
    return base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def private_data(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Per row of ``docs``: key, ``base`` and ``spans`` (kind, start, end; in code points, end exclusive) by kind and start.

    A null or empty text has no spans. Rows that repeat key or text get equal results, a row each; a null key
    stays null. Other columns of ``docs`` are not looked at. Time follows the length of a text, also where
    it is one word. Of segmentations that score alike the one with fewer segments counts.
    """
    ship(docs.sparkSession)
    model = field or trained()
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [all_spans(value.as_py(), model) for value in batch["text"]]
            columns = [pa.array([named(f[k]) for f in found], fields) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["key"], *columns], ["key", "base", "spans"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(search, f"key {kind}, base {SPANS}, spans {SPANS}").withColumnRenamed("key", key)


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return private_data(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(F.encode(joined("base"), "UTF-8"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


QUERIES = {"op11_private_data": op11_private_data}

SQL: dict[str, str] = {}
