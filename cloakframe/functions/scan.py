"""The pattern stage over one text, in time that grows with the text: all rules, their validators and what follows them.

Runs in Arrow batches on the executors (operators/detectors.py). A span is a tuple (start, end, entity type, score, detector,
validated) in code points. A search that runs longer than TIMEOUT raises, so that a text which was not fully checked is
never written."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import regex

from ..plans import spec

Span = tuple[int, int, str, float, str, bool]
#: Seconds that one search may take.
TIMEOUT = 60.0


class PatternTimeout(RuntimeError):
    """A search ran too long; the message names the rule, never the text."""


def compiled(pattern: str, fold: bool) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\z", r"\Z"), regex.IGNORECASE if fold else 0)


# --- rules --------------------------------------------------------------------------------------------


class Search:
    """Matches of a rule, from left to right, none overlapping another."""

    def __init__(self, rule: spec.Rule):
        self.rule, fold = rule, "i" in rule.flags
        self.only, self.whole = compiled(rule.only, fold), compiled(rule.pattern, fold)
        self.core = compiled(rule.core, fold) if rule.core else None

    def spans(self, text: str, room: int) -> Iterator[tuple[int, int]]:
        """`room` is the longest run of white space of the text."""
        try:
            if self.only.search(text, timeout=TIMEOUT):
                yield from self._near_cores(text, room) if self.core else (m.span() for m in self.whole.finditer(text, timeout=TIMEOUT))
        except TimeoutError:
            raise PatternTimeout(f"the search for {self.rule.entity} ({self.rule.name}) ran too long") from None

    def _near_cores(self, text: str, room: int) -> Iterator[tuple[int, int]]:
        """The matches of free text up to a core. A match starts at most spec.PARTS parts before its core; what lies farther
        away isn't looked at. Whatever reaches beyond a core also reaches the core, so the leftmost start is found by a
        search that ends at the core, and the match from there is taken in full."""
        reach, done = spec.PARTS * (spec.PART_LENGTH + 1 + room), 0
        for core in self.core.finditer(text, overlapped=True, timeout=TIMEOUT):
            lo = max(done, core.start() - reach)
            if lo > core.start():
                continue
            if first := self.whole.search(text, lo, min(len(text), core.end() + 1), timeout=TIMEOUT):
                found = self.whole.match(text, first.start(), timeout=TIMEOUT)
                yield found.span()
                done = found.end()


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return bool(values) and (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def ssn_issued(digits: str) -> bool:
    return not (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:9] == "0000")


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


_DIGIT = regex.compile(r"\d")
_CHECKS = {
    "luhn": luhn,
    "card": lambda digits: 13 <= len(digits) <= 19 and luhn(digits),
    "ssn": ssn_issued,
}
_GLUED = regex.compile(r"[A-Z]{2}[0-9]{2}(?=[A-Z0-9 ]{11})")
_SPACED = regex.compile(r"\b[a-z]{2}[ -]?[0-9]{2}(?=(?:[ -]?[a-z0-9]){11})", regex.IGNORECASE)


def _taken(text: str, start: int, n: int, between: str) -> int | None:
    """End of n ASCII letters and digits from start, single characters of `between` allowed among them."""
    at, left, gap = start, n, True
    while at < len(text) and left:
        c = text[at]
        if c.isascii() and c.isalnum():
            left, gap = left - 1, False
        elif c in between and not gap:
            gap = True
        else:
            return None
        at += 1
    return None if left else at


def iban_spans(text: str) -> Iterator[Span]:
    """Capital IBANs wherever they start, glued to a label or not: certain if the checksum holds, else still a likely misread.
    Of any case and with dashes, as words of their own, only with a right checksum."""
    for m in _GLUED.finditer(text):
        n = spec.IBAN_LENGTHS.get(m.group()[:2])
        end = n and _taken(text, m.start(), n, " ")
        if end and text[m.start() : end].isupper():
            sure = mod97(text[m.start() : end].replace(" ", "")) == 1
            yield m.start(), end, "IBAN", 1.0 if sure else 0.6, "glued_iban", sure
    for m in _SPACED.finditer(text):
        n = spec.IBAN_LENGTHS.get(m.group()[:2].upper())
        end = n and _taken(text, m.start(), n, " -")
        if end and not text[end : end + 1].isalnum() and mod97("".join(c for c in text[m.start() : end] if c.isalnum()).upper()) == 1:
            yield m.start(), end, "IBAN", 1.0, "iban", True


class Scanner:
    """All rules and company terms, compiled once in a worker."""

    def __init__(self, rules: Iterable[spec.Rule], terms: Sequence[str]):
        searches = [Search(r) for r in rules]
        self.plain = [s for s in searches if s.rule.entity in ("EMAIL", "API_KEY")]
        self.numeric = [s for s in searches if s not in self.plain]  # each match holds a digit
        self.terms = [compiled(spec.term_pattern(t), True) for t in dict.fromkeys(terms) if t.strip()]
        self.cues = {k: compiled(v, True) for k, v in spec.CUES.items()}

    def raw(self, text: str) -> Iterator[Span]:
        numeric = bool(_DIGIT.search(text))
        room = max(map(len, regex.findall(r"\s+", text)), default=0) if numeric else 0
        for s in [*(self.numeric if numeric else ()), *self.plain]:
            rule, check = s.rule, _CHECKS.get(s.rule.check)
            score = 1.0 if rule.check in ("luhn", "card") else rule.score
            sure = rule.entity in spec.CONFIRMED and score >= spec.CONFIRMED_SCORE
            for start, end in s.spans(text, room):
                if check is None or check("".join(_DIGIT.findall(text, start, end))):
                    yield start, end, rule.entity, score, rule.source, sure
        if numeric:
            yield from iban_spans(text)
        for term in self.terms:
            for m in term.finditer(text, timeout=TIMEOUT):
                yield *m.span(), "COMPANY_TERM", 1.0, "company_term", True

    def spans(self, text: str, more: Iterable[Span] = ()) -> list[Span]:
        found = without_contained([*self.raw(text), *more])
        if found:
            found = with_joined_addresses(text, self.with_cues(text, found))
        return found

    def with_cues(self, text: str, spans: list[Span]) -> list[Span]:
        """Weak spans lifted where a cue stands shortly before them or heads their table column."""
        heads = Headers(text) if "|" in text else None

        def lift(s: Span) -> Span:
            cue = self.cues.get(s[2]) if s[3] < spec.CUE_SCORE else None
            if cue and (cue.search(text[max(0, s[0] - spec.CUE_WINDOW) : s[0]]) or heads and cue.search(heads.cell(s[0]))):
                return *s[:3], spec.CUE_SCORE, f"{s[4]}.context", s[5]
            return s

        return [lift(s) for s in spans]


@lru_cache(maxsize=4)
def scanner(rules: tuple[spec.Rule, ...], terms: tuple[str, ...]) -> Scanner:
    return Scanner(rules, terms)


# --- spans of one text --------------------------------------------------------------------------------


def without_contained(spans: Iterable[Span]) -> list[Span]:
    """Spans that no better span of their type covers; better is: a higher score, earlier, longer, by detector. Spans of a score
    of 0 go. Of each type the widest kept spans form a staircase, so that a look at one step tells."""
    stairs: dict[str, tuple[list[int], list[int]]] = {}
    kept = []
    for s in sorted(set(spans), key=lambda s: (-s[3], s[0], s[0] - s[1], s[4], not s[5])):
        starts, ends = stairs.setdefault(s[2], ([], []))
        at = bisect_right(starts, s[0])
        if s[3] <= 0 or at and ends[at - 1] >= s[1]:
            continue
        kept.append(s)
        at -= bool(at and starts[at - 1] == s[0])
        to = bisect_right(ends, s[1], lo=at)  # steps that this one covers
        starts[at:to], ends[at:to] = [s[0]], [s[1]]
    return sorted(kept)


def table_headers(text: str) -> list[int]:
    """For each line the number of the first line of its run of lines that hold "|"; -1 for lines without one."""
    out: list[int] = []
    for i, line in enumerate(text.split("\n")):
        out.append(-1 if "|" not in line else out[-1] if out and out[-1] >= 0 else i)
    return out


class Headers:
    """Header cells of the tables of a text."""

    def __init__(self, text: str):
        self.text, self.lines, self.tops = text, text.split("\n"), table_headers(text)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def cell(self, at: int) -> str:
        """Of the table column that an offset lies in; "" outside tables."""
        line = bisect_right(self.starts, at) - 1
        if self.tops[line] < 0:
            return ""
        column = self.text[self.starts[line] : at].strip(" ").lstrip("|").count("|")
        cells = self.lines[self.tops[line]].strip(" ").strip("|").split("|")
        return cells[column] if column < len(cells) else ""


def with_joined_addresses(text: str, spans: list[Span]) -> list[Span]:
    """The spans and, for each two neighbouring addresses on one line at most ADDRESS_GAP apart, one over both."""
    parts = sorted(s for s in spans if s[2] == "ADDRESS")
    near = [(a, b) for a, b in zip(parts, parts[1:], strict=False) if 0 < b[0] - a[1] <= spec.ADDRESS_GAP and "\n" not in text[a[1] : b[0]]]
    return [*spans, *((a[0], b[1], "ADDRESS", max(a[3], b[3]), "address.join", False) for a, b in near)]


def merged(spans: Iterable[Span]) -> list[Span]:
    """Spans that overlap become one: their union, named by the widest (then validated, higher score, type, detector). Spans
    that only touch stay apart."""
    out: list[tuple[int, int, tuple]] = []
    for s in sorted(spans):
        best = (s[1] - s[0], s[5], s[3], s[2], s[4])
        if out and s[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), max(out[-1][2], best))
        else:
            out.append((s[0], s[1], best))
    return [(start, end, kind, score, detector, sure) for start, end, (_, sure, score, kind, detector) in out]
