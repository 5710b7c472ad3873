"""Personal data by anchor expansion.

An Aho-Corasick automaton reports the anchors of a text: at-signs, plus signs, digits, schemes and
cue words. From an anchor a parser of its kind expands to the left and right within the text and
validates what it got. For the four base kinds the parsers reproduce leftmost, non-overlapping
matching of the fixed patterns below, each kind for itself; a match that fails validation is dropped
and not retried.

Kinds: email, ip, card, phone (base); account (an IBAN anywhere, by its check digits; a number of six digits
or more after an account cue; user info in a URL, up to its @) and address. An address is a street cue with a
house number: before it and any capitalised words between (`221b Upper Baker Street`, `10 rue de la Paix`), or after
it, where that is the custom, with the capitalised words between (`Calle Mayor 5`, `Hauptstraße 7`). Cues are whole
words, but compounds may end with the German ones. No part has a bound on its length.

Offsets are code points, ends exclusive. Work is linear in the text. Defined results: null text =
empty; an empty text has no spans; repeated rows are scanned row by row; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address")

# The patterns that the base kinds are defined by, from their anchor on.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)").match
_run = re.compile(r"[0-9]+").match
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match

# Cue words; those of addresses by where the number stands. A compound may end with the last ones.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta")
NUMBER_FIRST = ("street", "avenue", "road", "boulevard", "lane", "rue")
NUMBER_LAST = ("calle", "avenida", "plaza", "straße", "strasse", "rue", "avenue", "boulevard")
COMPOUND = ("straße", "strasse")
ADDRESS_CUES = tuple(dict.fromkeys((*NUMBER_FIRST, *NUMBER_LAST)))
# Countries whose accounts have an IBAN.
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
_account_number = re.compile(r"(?:\s*(?:no\.?|nr\.?|number|#|:|=))*+\s*([0-9](?:[ -]?[0-9]){5,}+)(?![0-9A-Za-z])", re.I).match
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])").match
_word = frozenset("_'.-")
_connecting = re.compile(r"(?:de|la|las|los|del|des|du|le) ").match
_number_after = re.compile(r",? [0-9]+[a-z]?(?![0-9A-Za-z])").match
_userinfo = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=:-]++(?=@[A-Za-z0-9.-])").match


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("s", 3))
    for country in IBAN_COUNTRIES:
        a.add_word(country, ("iban", 2))
    for kind, cues in (("account", ACCOUNT_CUES), ("address", ADDRESS_CUES)):
        for cue in cues:
            for w in {cue, cue.capitalize(), cue.upper()}:
                a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_anchors: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_span(text: str, at: int) -> tuple[int, int] | None:
    """An IBAN that begins here; groups at its end that do not belong to it are given up one by one."""
    if m := _iban(text, at):
        found = m.group()
        while len(found) >= 15:
            if mod97(found):
                return at, at + len(found)
            found = found.rpartition(" ")[0]
    return None


def _capitalised_after(text: str, at: int) -> int:
    """The end of the capitalised words after a cue: `de la Paz`, `Mayor`. Connecting words may stand before each."""
    while True:
        end = at
        while text[end : end + 1] == " " and (m := _connecting(text, end + 1)):
            end = m.end() - 1
        if text[end : end + 1] != " " or not text[end + 1 : end + 2].isupper():
            return at
        at = end + 2
        while at < len(text) and (text[at].isalnum() or text[at] in _word):
            at += 1


class _Before:
    """House numbers before a cue: `221b, Upper Baker Street`. Cues that were passed are remembered, so no word is read twice."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def start(self, cue: int, floor: int) -> int | None:
        """Where the number begins that belongs to the cue, if it does not begin before floor."""
        text, at, found = self.text, cue, None
        while True:
            if at in self.known:
                found = self.known[at]
                break
            end = at - 1  # a blank, then a word that ends there
            if end <= 0 or text[end] != " ":
                break
            comma = text[end - 1] == ","
            a = end - comma
            b = a
            while b > 0 and (text[b - 1].isalnum() or text[b - 1] in _word):
                b -= 1
            word = text[b:a]
            if not word:
                break
            if word[0].isdigit() and word.isascii():
                digits = word.rstrip("abcdefghijklmnopqrstuvwxyz")
                if digits.isdigit() and len(word) - len(digits) <= 1 and (b == 0 or text[b - 1].isspace()):
                    found = b
                break
            if comma or not word[0].isupper() or (b and not text[b - 1].isspace()):
                break
            at = b
        self.known[cue] = found
        return found if found is not None and found >= floor else None


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of every kind, in order."""
    if not _anchors:
        _anchors.append(_automaton())
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    before = _Before(text)
    email_end = ip_end = card_end = phone_end = account_end = address_end = run_end = 0
    for at, (kind, size) in _anchors[0].iter(text):
        if kind == "d":
            if at >= card_end and (m := _card(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((at, card_end))
            if at >= ip_end and at >= run_end:
                run_end = _run(text, at).end()  # a match from within a run of digits fails where one from its start does
                if text[run_end : run_end + 1] == "." and (m := _ip(text, at)):
                    ip_end = m.end()
                    if all(map(_octet, m.group().split("."))):
                        out["ip"].append((at, ip_end))
        elif kind == "@":
            if at >= email_end:
                start = at
                while start > email_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := _domain(text, at + 1)):
                    email_end = m.end()
                    out["email"].append((start, email_end))
        elif kind == "+":
            if at >= phone_end and (m := _phone(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out["phone"].append((at, phone_end))
        elif kind == "s":
            if m := _userinfo(text, at + 1):
                if m.start() >= account_end:
                    account_end = m.end()
                    out["account"].append(m.span())
        elif kind == "iban":
            if at - 1 >= account_end and not (at > 1 and text[at - 2].isalnum()) and (span := _iban_span(text, at - 1)):
                account_end = span[1]
                out["account"].append(span)
        elif kind == "account":
            if at + 1 >= account_end and not text[at + 1 : at + 2].isalpha() and (m := _account_number(text, at + 1)):
                account_end = m.end()
                out["account"].append(m.span(1))
        else:
            start, cue = at + 1 - size, text[at + 1 - size : at + 1].lower()
            inside = start > 0 and text[start - 1].isalpha()
            if start < address_end or text[at + 1 : at + 2].isalpha() or (inside and cue not in COMPOUND):
                continue
            span = None
            if cue in NUMBER_FIRST and (first := before.start(start, address_end)) is not None:
                span = first, _capitalised_after(text, at + 1) if cue in NUMBER_LAST else at + 1
            elif cue in NUMBER_LAST and (m := _number_after(text, _capitalised_after(text, at + 1))):
                while start > address_end and text[start - 1].isalpha():
                    start -= 1
                span = start, m.end()
            if span:
                address_end = span[1]
                out["address"].append(span)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, spans (kind:start:end, by kind then start, comma-joined), base_spans (the base kinds only) and a count per base kind."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(texts: list[str]) -> list[tuple]:
        out = []
        for t in texts:
            found = find(t)
            out.append((*(len(found[k]) for k in BASE), joined(found, BASE), joined(found, KINDS)))
        return out

    src = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    counts = [f"n_{k}" for k in BASE]
    return map_rows(src, run, f"id {kind}, {', '.join(f'{c} long' for c in counts)}, base_spans string, spans string", [*counts, "base_spans", "spans"]).withColumnRenamed("id", id_col)


def base_digest(text: str) -> str:
    return hashlib.sha256(joined(find(text), BASE).encode()).hexdigest()
