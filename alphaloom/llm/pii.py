"""Personal data by candidate gradient boosting.

High-recall generators propose spans of each kind that may overlap each other
and what the exact rules of the kinds find: obfuscated and spaced addresses,
dotted quads in brackets, digit groups under other separators, long mixed
strings and assigned values. Boosted trees judge every proposal by its format
and its surroundings, and it is redacted if its probability reaches the
threshold calibrated for its kind. Spans that the exact rules accept always stay.

Calibration is cross-fitted over forms: a form is one way of writing a kind or
one sort of look-alike. For each third of the forms and of the documents, trees
that have seen neither judge the examples of both; the thresholds come from these
judgements, the trees that are used from all examples.

The trees learn from a bounded sample of the corpus (``TRAINING_DOCS``
documents): exact spans where they stand, the same places with the span written
in an obfuscated form, invented data and look-alikes set into its prose, and the
corpus's own look-alikes that break a rule no true span breaks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.llm._boost import Boosted, fit_boosted

#: The kinds of the exact rules, and those with the method's own.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Calibration: least precision on examples of forms that the judging trees have not seen, and the threshold's lower bound.
PRECISION, LEAST_THRESHOLD = 0.995, 0.6
#: Parts of the forms and of the documents that are left out in turn.
FOLDS = 3
#: Bounds of the sample that the trees learn from: documents, places taken from one document, and examples made.
TRAINING_DOCS, PLACES, EXAMPLES = 2000, 6, 9000
BEFORE, AFTER = 48, 24

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Looser generators, by kind; an e-mail address is found from its at sign, see ``_loose_emails``.
_LOOSE = {
    "ip": re.compile(r"[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)\s?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:[./_  ‐-― -]{1,2}[0-9]{4}){3}|[0-9]{4}[./_ -][0-9]{6}[./_ -][0-9]{5}|[0-9]{13,19}"),
    "phone": re.compile(r"(?:\([0-9]{2,5}\)[\x20.-]?[0-9]{2,4}|00[0-9]{1,3}[\x20.-][0-9]{2,4}|0?[0-9]{2,4}[\x20./-][0-9]{3,4})(?:[\x20./-][0-9]{2,5}){1,3}"),
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{16,}"),
}
_AT = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\}|\s[Aa][Tt]\s|@)\s?")
_NO_START = "._%+-"
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|\s[Dd][Oo][Tt]\s)\s?[A-Za-z]{2,})+")
_SPACED_DOT = re.compile(r"\.\s|\s\.")
_ASSIGNED = re.compile(r"(?:pass(?:word|wd)?|pwd|secret|token|key)[\x20]{0,2}[:=][\x20]{0,2}[\"']?([^\s\"']{6,})", re.IGNORECASE)
_HINTS = {
    "email": ("mail", "contact", "write", "reach", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "pay", "kart", "carte", "tarjeta", "account"),
    "secret": ("token", "secret", "key", "password", "passwd", "bearer", "auth", "credential"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "whatsapp", "llam", "appel", "ruf"),
}
_AGAINST = ("version", "isbn", "order", "page", "article", "section", "part", "ref", "id", "build", "no.", "date", "figure", "sha", "md5", "commit", "hash", "uuid", "checksum", "etag", "digest")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact rules, per kind leftmost and without overlap, in code points.

    Each rule starts from what any match must hold (an @, a run of digits, a
    plus), so a long run of word characters or digits takes linear time.
    """
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    if _has_digit(text):
        for run in _DOTTED.finditer(text):
            parts = run.group().split(".")
            place = run.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append(("ip", place, place + size))
                place += size + 1
        for run in _NUMBER.finditer(text):
            if 12 <= run.end() - run.start():
                digits = _digits(run.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", run.start(), run.end()))
        place = text.find("+")
        while place >= 0:
            run = _PHONE.match(text, place)
            end = place + 1
            if run:
                whole = run.group().rstrip(" ().-")
                if len(whole) >= 4:
                    end = place + len(whole)
                    if 9 <= len(_digits(whole)) <= 15:
                        found.append(("phone", place, end))
            place = text.find("+", end)
    return _ordered(found)


_ANY_DIGIT = re.compile("[0-9]")


def _has_digit(text: str) -> bool:
    return _ANY_DIGIT.search(text) is not None


def _ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _loose_emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Addresses from their at sign: the whole run of name characters before it, and all labels after it.

    A full stop with white space ends a sentence more often than it joins
    labels, so the stretch before the first of those is proposed too.
    """
    for at in _AT.finditer(text):
        start = at.start()
        while start and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        while start < at.start() and text[start] in _NO_START:
            start += 1
        domain = _AFTER_AT.match(text, at.end()) if start < at.start() else None
        if domain:
            yield "email", start, domain.end()
            spaced = _SPACED_DOT.search(text, at.end(), domain.end())
            if spaced and (short := _AFTER_AT.match(text, at.end(), spaced.start())):
                yield "email", start, short.end()


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Distinct candidates of the looser generators; they may overlap each other and the exact spans."""
    found = list(_loose_emails(text))
    if _has_digit(text):
        for kind, pattern in _LOOSE.items():
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if kind != "secret" or _mixed(m.group())]
    found += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    return _ordered(set(found))


def _mixed(span: str) -> bool:
    return _has_digit(span) and any(c.isalpha() for c in span)


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    prev, following = text[start - 1 : start], text[end : end + 1]
    parts = [p for p in re.split(r"[^0-9A-Za-z]+", span) if p]
    groups = [len(p) for p in parts]
    letters = sum(c.isalpha() for c in span)
    last = before.rstrip(" \"'")[-1:]
    return [
        KINDS.index(kind),
        len(span),
        len(digits),
        letters,
        len(span) - len(digits) - letters,
        len(parts),
        max(groups, default=0),
        min(groups, default=0),
        len(groups and parts[-1]),
        float("@" in span),
        float(any(x in span for x in ("[", "(", "{"))),
        sum(c.isspace() for c in span),
        float(len(digits) > 1 and luhn(digits)),
        float(digits[:1] == "0"),
        float(all(len(p) <= 3 and int(p) <= 255 for p in parts if p.isdigit() and len(p) < 10)) if digits else 0.0,
        len(set(digits)),
        float(prev.isalnum()),
        float(following.isalnum()),
        float(prev in ("-", ".", "/", "#", "_") and prev != ""),
        float(following in ("-", "/", "_") and following != ""),
        float(any(h in before for h in _HINTS[kind])),
        float(any(h in before for h in _AGAINST)),
        float(any(h in after for h in _HINTS[kind])),
        float(bool(re.search(r"\b(at|dot)\b", span.lower()))),
        sum(p.lower() in ("at", "dot") for p in parts),
        float(last == "="),
        float(last == ":"),
        float(prev in ("'", '"') and prev != ""),
        len(set(span)) / max(1, len(span)),
        float(all(c in "0123456789abcdef" for c in span.lower())),
        sum(c.isupper() for c in span),
        sum(span[i].isdigit() != span[i - 1].isdigit() for i in range(1, len(span))),
        len(_SPACED_DOT.findall(span)),
    ]


@dataclass(frozen=True)
class Reliability:
    """Of one kind's examples whose forms the judging trees have not seen: number, precision and recall at the threshold, and the mean distance of probability from truth over tenths."""

    kind: str
    examples: int
    precision: float
    recall: float
    calibration_error: float


@dataclass(frozen=True)
class Redactor:
    """The trees and, of each kind, the calibrated threshold and what examples of unseen forms say of it."""

    trees: Boosted
    thresholds: tuple[float, ...]
    reliability: tuple[Reliability, ...] = ()

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Exact spans, and all accepted spans.

        Every proposal that no exact span covers is judged, those that overlap
        one too. Of the accepted, one that another covers goes, however probable:
        the longer span is redacted whole. The rest are taken by falling
        probability (ties: from the left), each unless it overlaps one taken
        before; exact spans stay.
        """
        base = base_spans(text)
        loose = loose_spans(text)
        if base and loose:
            reach = np.maximum.accumulate([e for _, _, e in base])
            starts = [s for _, s, _ in base]
            loose = [c for c in loose if (i := int(np.searchsorted(starts, c[1], "right"))) == 0 or reach[i - 1] < c[2]]
        if not loose:
            return base, base
        p = self.trees.probability(np.array([describe(text, *c) for c in loose], dtype=float))
        accepted = [i for i, (kind, _, _) in enumerate(loose) if p[i] >= self.thresholds[KINDS.index(kind)]]
        widest, reach = [], -1
        for i in sorted(accepted, key=lambda i: (loose[i][1], -loose[i][2], -p[i])):
            if loose[i][2] > reach:
                widest.append(i)
                reach = loose[i][2]
        kept: list[tuple[str, int, int]] = []
        marked = bytearray(len(text))
        for i in sorted(widest, key=lambda i: -p[i]):
            _, start, end = loose[i]
            if marked.find(1, start, end) < 0:
                kept.append(loose[i])
                marked[start:end] = b"\x01" * (end - start)
        return base, _ordered(base + kept)


def breaks_rule(kind: str, span: str) -> bool:
    """Whether a candidate breaks a rule that no true span of its kind breaks."""
    digits = _digits(span)
    if kind == "card":
        return not (12 <= len(digits) <= 19 and luhn(digits))
    if kind == "ip":
        return any(int(p) > 255 for p in re.findall("[0-9]+", span))
    return kind == "email" and _SPACED_DOT.search(span) is not None


def _places(docs: DataFrame, rows: int) -> list[tuple[int, str, str, str, str]]:
    """``fold, before, span, after, kind`` of places in at most ``rows`` documents, those with the smallest hash of their id.

    Kind ``""`` is a place between two words without a span, ``!kind`` a
    look-alike that breaks a rule. At most ``PLACES`` of each sort are taken from one document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                base = base_spans(text)
                found = base[:PLACES]
                found += [("!" + k, a, b) for k, a, b in loose_spans(text) if breaks_rule(k, text[a:b])][:PLACES]
                blanks = [m.start() for m in re.finditer(" ", text)]
                found += [("", at, at) for at in blanks[:: len(blanks) // PLACES + 1]]
                out += [(fold, text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER], k) for k, a, b in found]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.string()] * 4, strict=True)], ["fold", "before", "span", "after", "kind"])

    own = F.xxhash64(F.col("doc_id").cast("long"), F.lit(5))
    chosen = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("order")).distinct().orderBy("order", "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "order").agg(F.min("text").alias("text"))
    found = one.select("text", F.pmod("order", F.lit(FOLDS)).cast("long").alias("fold")).mapInArrow(cut, "fold long, before string, span string, after string, kind string")
    return sorted((r.fold, r.before, r.span, r.after, r.kind) for r in found.toLocalIterator())


class _Maker:
    """Invented data of every kind, look-alikes of it, and the words that lead up to either."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def form(self, options) -> tuple[int, str]:
        """One of ``options`` and its number, which is the form's."""
        number = int(self.rng.integers(len(options)))
        return number, options[number]

    def number(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def word(self, a: int = 2, b: int = 9) -> str:
        return "".join(chr(97 + int(c)) for c in self.rng.integers(0, 26, int(self.rng.integers(a, b))))

    def mixed(self, n: int, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") -> str:
        return "".join(letters[int(i)] for i in self.rng.integers(0, len(letters), n))

    def long(self) -> int:
        """Lengths well beyond those of usual secrets, small ones oftener."""
        return int(2 ** self.rng.uniform(6, 12))

    def address(self, span: str = "") -> tuple[int, str]:
        """The form and text of an obfuscated address; the form is how its at sign is written."""
        user, domain = span.split("@") if span else (self.pick((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.number(2)}")), f"{self.word(3)}.{self.pick(('com', 'org', 'net', 'de', 'fr', 'es', 'io'))}")
        at, dot = self.pick(("[at]", " at ", "(at)", " @ ", " [at] ", " (at) ")), self.pick((".", " dot ", "[dot]", " (dot) "))
        return ("[at]", "at", "(at)", "@").index(at.strip()), user + at + domain.replace(".", dot)

    def good(self, kind: str, span: str = "") -> tuple[int, str]:
        """The form and text of a true span of ``kind``: ``span`` in another form, or an invented one."""
        if kind == "email":
            return self.address(span)
        if kind == "ip":
            parts = span.split(".") if span else [str(int(v)) for v in self.rng.integers(0, 256, 4)]
            form, dot = self.form(("[.]", "(.)", "[dot]", " . "))
            return form, dot.join(parts)
        if kind == "card":
            digits = _digits(span)
            if len(digits) != 16:
                body = self.pick("3456") + self.number(14)
                digits = body + next(str(d) for d in range(10) if luhn(body + str(d)))
            form, mark = self.form("./_–")
            return form, mark.join(digits[i : i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            n = self.number
            return self.form((f"({n(3)}) {n(3)}-{n(4)}", f"00{self.pick('123456789')}{n(1)} {n(3)} {n(5)} {n(3)}", f"0{n(3)} {n(3)} {n(4)}", f"{n(3)}-{n(3)}-{n(4)}"))
        return self.form((self.mixed(40, "0123456789abcdef"), self.mixed(32, "0123456789abcdef"), self.mixed(36), "AKIA" + self.mixed(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "sk-" + self.mixed(32), "ghp_" + self.mixed(36), self.mixed(9) + self.number(1), self.mixed(self.long()), self.mixed(self.long(), "0123456789abcdef")))

    def bad(self, kind: str) -> tuple[int, str]:
        """The form and text of a look-alike of ``kind``."""
        n = self.number
        if kind == "email":
            user, (form, at) = self.word(), self.form((" at ", " @ "))
            return form, user + at + self.word() + self.pick((". ", " . ", ". ")) + self.word(3)
        if kind == "ip":
            form, dot = self.form((".", "[.]", " . "))
            return form, dot.join(str(int(v)) for v in self.rng.integers(256, 1000, 4))
        if kind == "card":
            body = n(15)
            form, mark = self.form(("", ".", " ", "_", "-"))
            return form, mark.join((body + next(str(d) for d in range(10) if not luhn(body + str(d))))[i : i + 4] for i in range(0, 16, 4))
        if kind == "phone":
            return self.form((f"20{n(2)}-{n(3)}-{n(2)}", f"{n(2)}/{n(4)}/{n(2)}", f"{n(3)} {n(3)} {n(3)} {n(3)}", f"{n(4)}.{n(4)}.{n(2)}", f"{n(3)}.{n(3)}.{n(3)}"))
        return self.form((self.mixed(40, "0123456789abcdef"), self.mixed(32, "0123456789abcdef"), f"{self.mixed(8, '0123456789abcdef')}-{n(4)}-4{n(3)}-{n(4)}-{n(12)}", "/".join(self.word(4) for _ in range(4)) + n(2), "_".join(self.word(4) for _ in range(4)) + n(1), "=" * 20 + self.word(2) + n(1), "/".join(self.word(4) for _ in range(self.long() // 6)) + n(2), "-" * self.long() + n(1) + "a"))

    def lead(self, kind: str, good: bool) -> str:
        hint = self.pick(_HINTS[kind] if good else _AGAINST)
        if kind == "secret" and good:
            return hint + self.pick((" = ", "=", ": ", ' = "', "='", ":", " "))
        bare = {"email": 0.6, "ip": 0.7, "card": 0.5, "phone": 0.1}.get(kind, 0)
        if self.rng.random() < (bare if good else 0.5):
            return "" if good else self.pick(("", "#", self.word() + "-", n + "-" if (n := self.number(2)) else "", self.word() + ", "))
        return hint + self.pick((": ", " ", " is ", " no "))

    def cased(self, text: str) -> str:
        return text.upper() if self.rng.random() < 0.1 else text


def _threshold(p: np.ndarray, good: np.ndarray) -> float:
    """The least level from which on precision never falls below ``PRECISION``; where no level does, that of the best precision."""
    levels, place = np.unique(p, return_inverse=True)
    right, n = np.bincount(place, good, len(levels)), np.bincount(place, minlength=len(levels))
    precision = np.cumsum(right[::-1])[::-1] / np.maximum(np.cumsum(n[::-1])[::-1], 1)
    short = np.flatnonzero(precision < PRECISION)
    first = 0 if not len(short) else int(short[-1]) + 1
    if first == len(levels):
        first = int(precision.argmax()) if len(levels) else 0
    return float(max(LEAST_THRESHOLD, levels[first])) if len(levels) else LEAST_THRESHOLD


def _reliability(kind: str, p: np.ndarray, good: np.ndarray, threshold: float) -> Reliability:
    taken = p >= threshold
    tenth = np.minimum((p * 10).astype(int), 9)
    n = np.bincount(tenth, minlength=10)
    apart = np.abs(np.bincount(tenth, p, 10) - np.bincount(tenth, good, 10)).sum() / max(1, n.sum())
    return Reliability(kind, len(p), float(good[taken].mean()) if taken.any() else 1.0, float(taken[good == 1].mean()) if good.any() else 0.0, float(apart))


@lru_cache(maxsize=4)
def _fit(places: tuple[tuple[int, str, str, str, str], ...], examples: int, seed: int) -> Redactor:
    make = _Maker(np.random.default_rng(seed))
    blanks = [p for p in places if not p[4]] or [(i % FOLDS, make.word() + " " + make.word(), "", " " + make.word() + " " + make.word() + ".", "") for i in range(600)]
    rows: list[tuple[int, int, str, int, str, int, int]] = []

    def add(fold: int, form: int, before: str, lead: str, span: str, after: str, kind: str, good: int) -> None:
        text = f"{before}{lead}{span}{after}"
        start = len(before) + len(lead)
        rows.append((fold, form if form < 0 else form % FOLDS, kind, good, text, start, start + len(span)))

    real = [p for p in places if p[4]][: examples // 2]
    for fold, before, span, after, kind in real:
        # look-alikes of the corpus have the documents' fold as their form's; exact spans are never judged, so they are in no fold
        add(fold, fold if kind.startswith("!") else -1, before, "", span, after, kind.lstrip("!"), int(not kind.startswith("!")))
        if kind in ("email", "ip", "card"):
            form, other = make.good(kind, span)
            add(fold, form, before, "", other, after, kind, 1)
    while len(rows) < examples:
        fold, before, _, after, _ = make.pick(blanks)
        kind, good = make.pick(KINDS), bool(make.rng.random() < 0.5)
        form, span = make.good(kind) if good else make.bad(kind)
        before = before + " " if not before.endswith(" ") else before
        add(fold, form, before, make.cased(make.lead(kind, good)), make.cased(span) if kind != "card" else span, after if not after[:1].isalnum() else " " + after, kind, int(good))
    x = np.array([describe(text, kind, a, b) for _, _, kind, _, text, a, b in rows], dtype=float)
    y = np.array([r[3] for r in rows], dtype=float)
    fold, form = (np.array([r[i] for r in rows]) for i in (0, 1))
    unseen = np.full(len(rows), np.nan)
    for part in range(FOLDS):
        fitted, judged = (fold != part) & (form != part), (fold == part) & (form == part)
        if fitted.any() and judged.any():
            unseen[judged] = fit_boosted(x[fitted], y[fitted], trees=60, depth=4).probability(x[judged])
    thresholds, reliability = [], []
    for k, kind in enumerate(KINDS):
        own = (x[:, 0] == k) & ~np.isnan(unseen)
        thresholds.append(_threshold(unseen[own], y[own]))
        reliability.append(_reliability(kind, unseen[own], y[own], thresholds[-1]))
    return Redactor(fit_boosted(x, y, trees=60, depth=4), tuple(thresholds), tuple(reliability))


def train_redactor(docs: DataFrame | None = None, rows: int = TRAINING_DOCS, examples: int = EXAMPLES, seed: int = 11) -> Redactor:
    """Fit on a sample of at most ``rows`` documents of ``docs`` and calibrate on examples of unseen forms in unseen documents of it.

    A kind's threshold is the smallest from which on precision on these examples
    stays at ``PRECISION`` or more (where none does, that of the best
    precision), and ``LEAST_THRESHOLD`` at least.
    Of an id that stands for several texts the smallest text counts; null ids and texts are left
    out. Without ``docs``, or if these are empty, invented words surround the examples.
    """
    return _fit(tuple(_places(docs, rows)) if docs is not None else (), examples, seed)


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by its first span's kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, redactor: Redactor) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    Counts and the hash are of the exact spans; ``spans`` lists all accepted
    ones as ``kind:start:end``. Null texts are empty and, like texts without
    personal data, have zero counts and no spans. A narrow map over whole texts:
    repeated rows are scanned one by one, an empty table gives an empty result,
    other columns are ignored. Very long texts are scanned whole, in time linear in their length.
    """
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, spans = redactor.spans(text.as_py())
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_column(docs: DataFrame, redactor: Redactor, text: str = "text") -> DataFrame:
    """``docs`` with accepted spans replaced in ``text``; null texts stay null, all other columns stay as they are."""
    at = docs.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else redact(t, redactor.spans(t)[1]) for t in (v.as_py() for v in batch.column(at))]
            columns = [pa.array(new, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(replace, docs.schema)
