"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a whole text in one pass: at-signs (also written
out or percent-encoded), plus signs, digits, scheme ends and words that announce an account. A small
deterministic parser at each anchor expands it to its boundaries and validates it.

The four base kinds are those of fixed patterns, leftmost and without overlap within a kind; a match
that fails its validation is dropped and takes its characters with it:

``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
``ip``     four runs of digits joined by dots, each at most 255
``card``   digits with at most one blank or hyphen between two, 14 to 19 of them, passing Luhn's sum
``phone``  a plus sign, a digit, then digits, blanks, dots, hyphens and brackets up to a last digit; 10 to 15 digits

The added kinds need an anchor that says what they are, so that plain numbers are left alone:

``hidden_email``  ``name [at] host [dot] tld``, ``name(at)host.tld`` and ``name%40host.tld``, the host ending in letters
``login``         name and password in front of the host of an address with a scheme
``ip6``           an IP address of version 6 in brackets after a scheme
``iban``          after the word IBAN, with its check digits
``account``       6 to 17 digits after the words account or acct
``ssn``           ``ddd-dd-dddd`` of a range in use after SSN or social security
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from seriesloom.llm.common import map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("hidden_email", "login", "ip6", "iban", "account", "ssn")
KINDS = BASE + ADDED
ORDER = {kind: i for i, kind in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGITS | frozenset(" ().-")

AT_SIGNS = ("[at]", "(at)", "[AT]", "(AT)", " [at] ", " (at) ", " [AT] ", " (AT) ", "%40")
DOTS = re.compile(r" ?[\[(](?:dot|DOT)[\])] ?|\.")
WORDS = {"iban": "iban", "account": "account", "acct": "account", "ssn": "ssn", "social security": "ssn"}
# What may stand between an announcing word and its number.
LINK = re.compile(r"[ \t]{0,2}(?:(?:number|no\.?|nr\.?|num)\b)?[ \t]{0,2}(?:[:=#]|is\b)?[ \t]{0,2}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9A-Za-z]|[.,][0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")

Span = tuple[int, int, str]


def anchors():
    """The automaton. Values name the parser; a longer anchor that ends where a shorter one does also fires."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for digit in DIGITS:
        machine.add_word(digit, ("number", 1))
    machine.add_word("@", ("email", 1))
    machine.add_word("+", ("phone", 1))
    machine.add_word("://", ("scheme", 3))
    for sign in AT_SIGNS:
        machine.add_word(sign, ("hidden_email", len(sign)))
    for word, kind in WORDS.items():
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            machine.add_word(form, (kind, len(form)))
    machine.make_automaton()
    return machine


def _run(text: str, at: int, inside: frozenset) -> int:
    """End of the run of characters of a class from ``at``."""
    n = len(text)
    while at < n and text[at] in inside:
        at += 1
    return at


def _back(text: str, at: int, least: int, inside: frozenset) -> int:
    """Start of the run of characters of a class that ends at ``at``, not before ``least``."""
    while at > least and text[at - 1] in inside:
        at -= 1
    return at


def _host(text: str, at: int) -> int:
    """End of two or more labels joined by dots from ``at``; ``at`` where there are none."""
    end = _run(text, at, LABEL)
    dots = 0
    while at < end < len(text) and text[end] == "." and (more := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = more, dots + 1
    return end if dots else at


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _card_chain(text: str, at: int) -> tuple[int, int]:
    """End of the chain of digits from ``at`` and their number."""
    n, count = len(text), 0
    while True:
        end = _run(text, at, DIGITS)
        count += end - at
        if end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return end, count


def _dotted_chain(text: str, at: int) -> list[tuple[int, int]]:
    """Runs of digits joined by single dots from ``at``."""
    parts = []
    while True:
        end = _run(text, at, DIGITS)
        parts.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return parts


def _octet(text: str, part: tuple[int, int]) -> bool:
    value = text[part[0] : part[1]].lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _phone(text: str, plus: int) -> Span | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    # one character at least between the first digit and the last
    if end <= plus + 3 or not 10 <= sum(c in DIGITS for c in text[plus:end]) <= 15:
        return None
    return plus, end, "phone"


def _hidden_email(text: str, start: int, end: int) -> Span | None:
    """A name before a written-out at-sign, a host with written-out or plain dots behind it."""
    first = _back(text, start, max(0, start - 64), LOCAL - {"%"})
    last = stop = _run(text, end, LABEL)
    labels = [text[end:stop]]
    while labels[-1] and (dot := DOTS.match(text, stop)) and (more := _run(text, dot.end(), LABEL)) > dot.end():
        labels.append(text[dot.end() : more])
        last = stop = more
    if first == start or len(labels) < 2 or not 2 <= len(labels[-1]) <= 24 or not labels[-1].isalpha():
        return None
    return first, last, "hidden_email"


def _scheme(text: str, end: int) -> Span | None:
    """What an address with a scheme tells of a person: a login, or a bracketed host of version 6."""
    if text[end : end + 1] == "[" and (close := text.find("]", end, end + 48)) > 0:
        try:
            ipaddress.IPv6Address(text[end + 1 : close])
        except ValueError:
            return None
        return end + 1, close, "ip6"
    stop = end
    while stop < len(text) and stop < end + 256 and text[stop] not in " \t\n\x0b\x0c\r/?#\"'<>@":
        stop += 1
    if stop < len(text) and text[stop] == "@" and ":" in text[end + 1 : stop - 1] and text[stop + 1 : stop + 2] in LABEL:
        return end, stop, "login"
    return None


def _announced(text: str, start: int, end: int, kind: str) -> Span | None:
    """The number behind an announcing word that stands by itself."""
    if start and text[start - 1].isalnum():
        return None
    at = LINK.match(text, end).end()
    if at == end:
        return None
    found = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[kind].match(text, at)
    if not found:
        return None
    if kind == "iban":
        value = found.group().replace(" ", "")
        if len(value) > 34 or int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 != 1:
            return None
    return found.start(), found.end(), kind


def find(text: str, machine) -> list[Span]:
    """Spans ``(start, end, kind)`` of a whole text in code points, by start and then kind."""
    spans: list[Span] = []
    past = dict.fromkeys(("email", "ip", "card", *ADDED), 0)
    for last, (what, size) in machine.iter(text):
        start, end = last + 1 - size, last + 1
        if what == "number":
            if start >= past["card"]:
                past["card"], count = _card_chain(text, start)
                if 14 <= count <= 19 and _luhn("".join(c for c in text[start : past["card"]] if c in DIGITS)):
                    spans.append((start, past["card"], "card"))
            if start >= past["ip"]:
                parts = _dotted_chain(text, start)
                past["ip"] = parts[-1][1]
                for i in range(0, len(parts) - 3, 4):
                    if all(_octet(text, p) for p in parts[i : i + 4]):
                        spans.append((parts[i][0], parts[i + 3][1], "ip"))
        elif what == "email":
            first = _back(text, start, past["email"], LOCAL)
            if first < start and (stop := _host(text, end)) > end:
                past["email"] = stop
                spans.append((first, stop, "email"))
        elif what == "phone":
            if found := _phone(text, start):
                spans.append(found)
        else:
            found = _hidden_email(text, start, end) if what == "hidden_email" else _scheme(text, end) if what == "scheme" else _announced(text, start, end, what)
            if found and found[0] >= past[found[2]]:
                past[found[2]] = found[1]
                spans.append(found)
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _searcher() -> Callable[[list[str]], dict]:
    machine = anchors()

    def run(texts: list[str]) -> dict:
        found = [find(t, machine) for t in texts]
        base = [[s for s in spans if s[2] in BASE] for spans in found]
        out = {f"n_{kind}": [sum(s[2] == kind for s in spans) for spans in base] for kind in BASE}
        out["n_added"] = [len(spans) - len(own) for spans, own in zip(found, base)]
        out["base_sha256"] = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
        return out | {"spans": [written(spans) for spans in found]}

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: counts of the base kinds, of added spans, and all spans.

    ``base_sha256`` is the digest of the base spans as ``kind:start:end``, by start and then kind, joined
    by commas; ``spans`` lists the base and the added ones alike. Places are code points, the end
    exclusive. A null or empty text has no span. Spans of different kinds may overlap.
    """
    made = ", ".join(f"n_{kind} long" for kind in BASE) + ", n_added long, base_sha256 string, spans string"
    return map_texts(docs.select("doc_id", "text"), ["doc_id"], _searcher, made)


def masked(docs: DataFrame, name: str = "masked_text") -> DataFrame:
    """``docs`` with a further column: the text, every span replaced by its kind in angle brackets.

    Overlapping spans are replaced together, under the kind that starts first.
    """

    def make():
        machine = anchors()

        def pieces(text: str) -> Iterator[str]:
            at = 0
            for start, end, kind in find(text, machine):
                if start >= at:
                    yield text[at:start]
                    yield f"<{kind}>"
                at = max(at, end)
            yield text[at:]

        return lambda texts: {name: ["".join(pieces(t)) for t in texts]}

    return map_texts(docs, docs.columns, make, f"`{name}` string")
