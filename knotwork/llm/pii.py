"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Fixed spans (leftmost, not overlapping within a kind, dropped when their check fails): email, ip, card, phone. They always stay.

The random field reads regions: words that hold a digit or an at sign, with the words after them that continue a number, and addresses
whose signs are spelled out. A candidate segment is a stretch of a region from one token border to another (tokens: letters, digits, one
other character). Its form is that of the first shape in FORMS that the whole of it has, or `none`; its features are the form with
the number of digits, blanks and character classes, the check that belongs to the form (Luhn, octets, mod 97), whether it is glued to
what stands beside it, and the cue words before it. Dynamic programming over segment ends chooses boundaries and kinds together
(Viterbi); weights are trained by gradient ascent on the conditional likelihood (forward-backward over segments) on generated
sentences, a fixed number of them, in which stretches of no form compete. When the trained weights leave no segment of no form a
score above 0 (that of staying outside), none can be in the best segmentation, and such segments are not laid out (`none_can_win`).
Segments of a form are bounded by the form: numbers by their digits, glued runs and spelled-out addresses by being whole.

Found segments that touch no fixed span are added; the kinds are those above, `secret` (keys, tokens, passwords) and `id` (account and
insurance numbers).

Null texts count as empty and give no span. One row out for each row in, repeated rows too; further columns pass or are ignored.
Memory is bounded by one text and its regions.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "id")
NONE_TOKENS = 6  # tokens of the longest segment without a form
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_ORDER = {k: i for i, k in enumerate(KINDS)}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def fixed_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        before = text[end:at]
        begin = at - (len(before) - len(before.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if octets(m[0]):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _DIGITS.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


_SEED = re.compile(r"[0-9@]+|::|[(\[{ ](?:at|AT)[)\]} ]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^\sA-Za-z0-9]")
_ON = re.compile(r" (?=[0-9(+]|[A-Z0-9]{4}(?!\S))")  # the next word continues a number
_END = re.compile(r"\s|\Z")
_LABELS = r"[^\W_]++(?:[._-]++[^\W_]++)*+"
_HOST = re.compile(rf"\s?{_LABELS}(?:\s?[(\[{{ ](?:dot|DOT)[)\]}} ]\s?{_LABELS})++")
REACH = 28  # characters before a segment in which cue words are looked for
CUES = {
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone"},
    "email": {"mail", "email", "contact", "write"},
    "card": {"card", "visa", "pay", "credit"},
    "ip": {"ip", "host", "server", "address"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "bearer", "pass"},
    "id": {"ssn", "iban", "account", "insurance"},
}
_CUE = {w: k for k, c in CUES.items() for w in c}

#: Shapes by name, in order of precedence; those of `whole` runs are tried at their ends only.
FORMS = {
    "hex": re.compile(r"[0-9a-fA-F]{24,}+"),
    "dotted": re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    "six": re.compile(r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?"),
    "address": re.compile(r"[\w.%+-]++@[\w-]+(?:\.[\w-]+)+"),
    "bracketed": re.compile(r"\(\d{3}\) ?\d{3}[ .-]\d{4}"),
    "grouped": re.compile(r"\d{3}[ .-]\d{3}[ .-]\d{4}"),
    "plus": re.compile(r"\+\d(?:[ ().-]{0,3}\d){6,14}"),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "fours": re.compile(r"\d{4}(?:[ -]?\d{4}){2,3}(?:[ -]?\d{1,3})?|\d{4}[ -]?\d{6}[ -]?\d{5}"),
    "plain": re.compile(r"\d+"),
    "decimal": re.compile(r"\d+[.,]\d+"),
    "date": re.compile(r"\d{1,4}[-/.:]\d{1,2}[-/.:]\d{1,4}"),
    "mixed": re.compile(r"(?=[A-Za-z_+-]*+[0-9])(?=[0-9_+-]*+[A-Za-z])[A-Za-z0-9]+(?:[_+-]+[A-Za-z0-9]+)*={0,2}"),
}
_WHOLE = re.compile(r"[A-Za-z0-9]+(?:[_+-]+[A-Za-z0-9]+)*={0,2}")  # runs that hex and mixed have to be the whole of
_NUMERIC = ("dotted", "bracketed", "grouped", "plus", "ssn", "iban", "fours", "plain", "decimal", "date")
_SIX = re.compile(r"[0-9a-fA-F:]*+")


def spelled(text: str) -> list[tuple[int, int]]:
    """Places of whole addresses whose signs are spelled out."""
    out: list[tuple[int, int]] = []
    if " dot " not in (low := text.lower()) and "dot" not in low:
        return out
    for m in _SEED.finditer(text):
        if m[0][0] in "0123456789@:":
            continue
        host = _HOST.match(text, m.end())
        if not host:
            continue
        begin = m.start() - (text[m.start() - 1 : m.start()] == " ")
        stop, least = begin, out[-1][1] if out else 0
        while begin > least and (text[begin - 1].isalnum() or text[begin - 1] in "_.%+-"):
            begin -= 1
        if begin < stop:
            out.append((begin, host.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, and the words after them that continue a number; none touch."""
    out: list[tuple[int, int]] = []
    done, at = 0, 0
    while m := _SEED.search(text, at):
        at = m.end()
        if m[0][0] not in "0123456789@:":
            at = m.start() + 1
            continue
        begin = m.start()
        while begin > done and not text[begin - 1].isspace():
            begin -= 1
        end = _END.search(text, m.end()).start()
        while on := _ON.match(text, end):
            end = _END.search(text, on.end()).start()
        out.append((begin, end))
        done = at = end
    return out


def form_of(s: str) -> str:
    return next((n for n, r in FORMS.items() if r.fullmatch(s)), "none")


def _borders(text: str, begin: int, end: int) -> list[int]:
    return [begin, *(m.end() for m in _TOKEN.finditer(text, begin, end))]


def candidates(text: str, begin: int, end: int, plain_too: bool = False) -> dict[tuple[int, int], str]:
    """Segments of a region and their forms; with plain_too also those of no form."""
    out: dict[tuple[int, int], str] = {}
    borders = _borders(text, begin, end)
    for n, a in enumerate(borders[:-1]):
        c = text[a]
        if c.isdigit() or c in "(+" or c.isupper():
            for name in _NUMERIC:
                m = FORMS[name].match(text, a, end)
                if not m:
                    continue
                last, k = m.end(), n + 1
                while k < len(borders) and (e := borders[k]) <= last:  # a shorter piece of the same form may be right
                    k += 1
                    if (e == last or name in ("plus", "iban", "fours")) and (a, e) not in out and FORMS[name].fullmatch(text, a, e):
                        out[a, e] = form_of(text[a:e])
    for m in _WHOLE.finditer(text, begin, end):
        name = form_of(m[0])
        if name in ("hex", "mixed"):
            out[m.span()] = name
    at = text.find("@", begin, end)
    while at >= 0:
        a = at
        while a > begin and (text[a - 1].isalnum() or text[a - 1] in "_.%+-"):
            a -= 1
        m = FORMS["address"].match(text, a, end) if a < at else None
        if m:
            out[m.span()] = "address"
        at = text.find("@", max(at + 1, m.end() if m else 0), end)
    if text.find("::", begin, end) >= 0 or text.count(":", begin, end) >= 7:
        for m in _SIX.finditer(text, begin, end):
            if m.end() - m.start() > 3 and m[0].count(":") >= 2 and FORMS["six"].fullmatch(m[0]) and any(x.isdigit() for x in m[0]):
                out[m.span()] = "six"
    if plain_too:
        for i, a in enumerate(borders[:-1]):
            for e in borders[i + 1 : i + 1 + NONE_TOKENS]:
                s = text[a:e]
                if (a, e) not in out and not s[0].isspace() and not s[-1].isspace() and any(x.isdigit() or x == "@" for x in s):
                    if form_of(s) == "none":
                        out[a, e] = "none"
    return out


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, a: int, b: int, form: str) -> tuple[str, ...]:
    """Features of the whole segment text[a:b]."""
    s = text[a:b]
    d = _DIGITS.sub("", s)
    left, right = text[a - 1 : a], text[b : b + 1]
    glued = left.isalnum() or right.isalnum() or left in "+._-" and left != "" or (right in "@-_" and right != "")
    if form == "none":
        out = ["1", "form=none", f"none digits={min(len(d) // 4, 3)}", f"none spaces={min(s.count(' '), 2)}"]
    else:
        out = ["1", f"form={form}", f"{form} digits={min(len(d), 20) if form in ('plain', 'fours', 'plus') else min(len(d) // 4, 5)}", f"{form} spaces={min(s.count(' '), 4)}"]
    out.append(f"glued={glued} {form == 'none'}")
    if form == "fours":
        out.append(f"luhn={12 <= len(d) <= 19 and luhn(d)}")
    elif form == "dotted":
        out.append(f"octets={octets(s)}")
    elif form == "iban":
        out.append(f"mod97={_mod97(s)}")
    elif form in ("mixed", "hex"):
        n, big, small = min(len(s) // 4, 8), any(c.isupper() for c in s), any(c.islower() for c in s)
        turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
        out += [f"{form} size={n}", f"{form} case={big}{small} {min(n, 4)}", f"{form} turns={min(turns, 6)}", f"{form} joined={'-' in s or '_' in s}", f"known={s.startswith(('AKIA', 'ASIA', 'ghp_', 'sk-', 'sk_', 'xox'))}"]
    # a cue is one of the last two words, or the last if a sign binds it to the segment
    words = re.findall(r"[a-z]+", text[max(0, a - REACH) : a].lower())[-2:]
    found = sorted({_CUE[w] for w in words if w in _CUE})
    bound = bool(found) and text[max(0, a - 3) : a].rstrip(" \"'")[-1:] in ("=", ":")
    out += [f"cue={k}" for k in found]
    if form != "none":
        out += [f"{form} cue={k} {bound}" for k in found]
    return tuple(out)


@dataclass
class Lattice:
    """A region's borders and candidate segments (first border, last border, features)."""

    borders: list[int]
    segments: list[tuple[int, int, tuple[str, ...]]]
    ending: list[list[int]] = field(default_factory=list)


def lattice(text: str, found: dict[tuple[int, int], str]) -> Lattice:
    borders = sorted({x for s in found for x in s})
    at = {x: i for i, x in enumerate(borders)}
    out = Lattice(borders, [(at[a], at[b], features(text, a, b, f)) for (a, b), f in sorted(found.items())])
    out.ending = [[] for _ in borders]
    for k, (_, j, _) in enumerate(out.segments):
        out.ending[j].append(k)
    return out


@dataclass
class Field:
    weights: np.ndarray  # kinds x features; staying outside scores 0
    number: dict[str, int]
    none_can_win: bool = True
    known: dict[tuple[str, ...], tuple[float, int]] = field(default_factory=dict, repr=False)

    def score(self, own: tuple[str, ...]) -> tuple[float, int]:
        """Score of the segment's best kind, and the kind; remembers a bounded number."""
        got = self.known.get(own)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            every = self.weights[:, [self.number[x] for x in own if x in self.number]].sum(1)
            k = int(every.argmax())
            got = self.known[own] = float(every[k]), k
        return got

    def best(self, text: str, found: dict[tuple[int, int], str]) -> list[Span]:
        """The segmentation of highest score."""
        if not found:
            return []
        lat = lattice(text, found)
        top, back = [0.0], [None]
        for j in range(1, len(lat.borders)):
            best, how = top[j - 1], None
            for s in lat.ending[j]:
                i, _, own = lat.segments[s]
                value, k = self.score(own)
                if top[i] + value > best:
                    best, how = top[i] + value, (i, k)
            top.append(best)
            back.append(how)
        out, j = [], len(lat.borders) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            i, k = back[j]
            out.append((KINDS[k], lat.borders[i], lat.borders[j]))
            j = i
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        """Of the whole text: regions, and spelled-out addresses with what they touch."""
        own, places = [], regions(text)
        whole = spelled(text)
        if whole:
            joined: list[list[int]] = []
            for a, b in sorted([*places, *whole]):
                if joined and a < joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            places = [(a, b) for a, b in joined]
        at = 0
        for a, b in places:
            found = candidates(text, a, b, self.none_can_win)
            while at < len(whole) and whole[at][1] <= b:
                found[whole[at]] = "spelled"
                at += 1
            own += self.best(text, found)
        return own


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[Span]]]:
    """Generated sentences with known spans, clean ones with numbers among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "or", "re", "in", "st", "qua", "ver", "ción", "eau", "ung", "do"]) for _ in range(rng.randint(1, 4)))
    draw = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    num = lambda k: draw("0123456789", k)
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        d = rng.choice("3456") + num(13 if rng.random() < 0.15 else 14)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        if len(d) == 15:
            return rng.choice([d, f"{d[:4]} {d[4:10]} {d[10:]}"])
        return rng.choice([d, " ".join(d[i : i + 4] for i in (0, 4, 8, 12)), "-".join(d[i : i + 4] for i in (0, 4, 8, 12))])

    def mail() -> str:
        name, host, top = word() + rng.choice(["", "." + num(2), "_" + word(), "-" + word()]), word() + rng.choice(["", num(1), "-" + word()]), rng.choice(["com", "org", "net"])
        if rng.random() < 0.2:  # names that could be keys, too
            name = rng.choice("abcd") + draw(every[26:], rng.randint(5, 60)) + num(1)
        name, host = (re.sub("[^a-z0-9._-]", "x", x) for x in (name, host))
        at, dot = rng.choice([("@", ".")] * 3 + [(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        return name + at + host + rng.choice(["", "", dot + re.sub("[^a-z]", "x", word())]) + dot + top

    def six() -> str:
        groups = [draw("0123456789abcdef", rng.randint(1, 4)) for _ in range(8)]
        k = rng.randint(1, 4)
        return rng.choice([":".join(groups), ":".join(groups[:k]) + "::" + num(1) + groups[7][1:]])

    def secret() -> str:
        kind = rng.randrange(6)
        if kind < 2:
            return draw("0123456789abcdef", rng.choice([32, 40, 40, 64]))
        if kind == 2:
            return rng.choice(["AKIA", "AKIA", "ASIA"]) + draw(every[:26] + num(9), 15) + num(1)
        if kind == 3:
            return rng.choice(["sk-", "ghp_", "sk_live_", "xoxb-"]) + draw(every, rng.randint(12, 36)) + num(1)
        return num(1) + draw(every, rng.randint(22, 44)) + rng.choice(["", "="])

    def iban() -> str:
        body = num(rng.choice([16, 18, 20]))
        country = rng.choice(["DE", "FR", "ES", "NL"])
        check = next(c for c in range(2, 99) if _mod97(f"{country}{c:02}{body}"))
        whole = f"{country}{check:02}{body}"
        return rng.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])

    def said() -> tuple[str, str]:
        """A password and the words that give it away: only those tell it from any other word with digits."""
        value = rng.choice([draw("0123456789abcdef", rng.randint(10, 16)) + num(1) + "b", word().replace("ó", "o") + num(rng.randint(1, 4)), draw(every[26:], rng.randint(6, 14)) + num(2)])
        return rng.choice(["password=", "password: ", "pwd=", "passwd=", "secret: ", "pass = ", 'password = "', "key=", "token=", "apikey="]), value

    make = {
        "email": mail,
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)) if rng.random() < 0.6 else six(),
        "card": card,
        "phone": lambda: rng.choice(["+1 ({}) {}-{}", "+{}{}{}", "({}) {}-{}", "{}-{}-{}", "+44 {} {} {}", "{}.{}.{}"]).format(num(3), num(3), num(4)),
        "secret": secret,
        "id": lambda: f"{num(3)}-{num(2)}-{num(4)}" if rng.random() < 0.5 else iban(),
        None: lambda: rng.choice(
            [num(rng.randint(1, 9)), num(rng.randint(10, 18)), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)},{num(3)}", f"{num(3)}.{num(1)}.{num(3)}", "v" + num(2), word() + "@" + word(), f"{num(3)}.{num(3)}.{num(3)}.999"]
            + [f"{num(2)}:{num(2)}:{num(2)}", f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", word() + num(rng.randint(1, 3)), draw(every[:26], 2) + "-" + num(4), num(1) + word() + num(1), f"${num(1)},{num(3)}.{num(2)}", word() + "-" + num(2), f"{num(4)} {num(3)}", f"({num(4)})", draw("abcdef0123456789", 7), f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}{word()}::{word()}", f"DE{num(2)} {num(4)} {num(4)} {num(4)}"]
        ),
    }
    for _ in range(n):
        kind = rng.choice([*KINDS, "secret", None, None, None, None])
        value = make[kind]()
        if kind is None and re.fullmatch(r"\d{12,19}", value) and luhn(value):
            value = "7"
        head = " ".join(word() for _ in range(rng.randint(0, 4)))
        if kind == "secret" and rng.random() < 0.4:
            cue, value = said()
            cue = " " + cue
        elif rng.random() < 0.5:
            cue = {"secret": ' token = "', "phone": " tel ", "id": rng.choice([" SSN ", " IBAN: ", " "])}.get(kind, " ")
        else:  # cue words stand before other things too
            cue = rng.choice([" ", " ", "\n", f" {rng.choice(sorted(_CUE))} "]) if kind not in ("secret", None) else rng.choice([" ", " ", "\n"])
            if kind is None and rng.random() < 0.2 and re.fullmatch(r"[\d.,:/-]+", value):
                cue = f" {rng.choice(['call', 'card', 'address', 'key', 'host', 'account', 'write', 'pay'])} "
        text = head + cue
        begin = len(text)
        text += value + rng.choice([" ", ".", ", ", "\n", "$$$ ", "!! "] if not cue.endswith('"') else ['"']) + " ".join(word() for _ in range(rng.randint(0, 4)))
        spans = [(kind, begin, begin + len(value))] if kind else []
        if kind == "phone" and rng.random() < 0.3:  # numbers beside each other
            number = card()
            begin = len(text := text[: begin + len(value)] + " ")
            text += number
            spans.append(("card", begin, begin + len(number)))
        yield text, spans


@functools.lru_cache
def train(n: int = 1500, seed: int = 11, rounds: int = 30, rate: float = 0.6, decay: float = 1e-3) -> Field:
    """Gradient ascent on the conditional log-likelihood of n generated sentences."""
    number: dict[str, int] = {}
    rows = []
    for text, spans in sentences(n, seed):
        for begin, end in {(0, len(text))} if spelled(text) else regions(text):
            found = candidates(text, begin, end, True)
            found |= {w: "spelled" for w in spelled(text)}
            if not found:
                continue
            lat = lattice(text, found)
            at = {(lat.borders[i], lat.borders[j]): k for k, (i, j, _) in enumerate(lat.segments)}
            inside = [(k, b, e) for k, b, e in spans if begin <= b and e <= end]
            gold = [(at[b, e], _ORDER[k]) for k, b, e in inside if (b, e) in at]
            if len(gold) == len(inside):
                rows.append((lat, gold))
    for lat, _ in rows:
        for _, _, own in lat.segments:
            for x in own:
                number.setdefault(x, len(number))
    m = len(number)
    # equal feature sets are scored once for all sentences
    kinds: dict[tuple[str, ...], int] = {}
    use = [np.array([kinds.setdefault(own, len(kinds)) for _, _, own in lat.segments]) for lat, _ in rows]
    x = np.zeros((len(kinds), m))
    for own, r in kinds.items():
        x[r, [number[f] for f in own]] = 1
    w, step = np.zeros((len(KINDS), m)), np.full((len(KINDS), m), 1e-8)
    for _ in range(rounds):
        every = x @ w.T
        pull = np.zeros_like(every)
        sums = np.logaddexp.reduce(every, axis=1)
        for (lat, gold), rows_ in zip(rows, use, strict=True):
            score, total, size = every[rows_], sums[rows_].tolist(), len(lat.borders)
            fwd, bwd = [0.0] * size, [-math.inf] * (size - 1) + [0.0]
            for j in range(1, size):
                terms = [fwd[j - 1]] + [fwd[lat.segments[s][0]] + total[s] for s in lat.ending[j]]
                top = max(terms)
                fwd[j] = top + math.log(sum(math.exp(t - top) for t in terms))
            for j in range(size - 1, 0, -1):  # push each place's mass to where its steps began
                for i, v in [(j - 1, bwd[j])] + [(lat.segments[s][0], bwd[j] + total[s]) for s in lat.ending[j]]:
                    top = max(bwd[i], v)
                    bwd[i] = top + math.log(math.exp(bwd[i] - top) + math.exp(v - top)) if top > -math.inf else top
            mass = np.array([fwd[i] + bwd[j] - fwd[-1] for i, j, _ in lat.segments])
            p = np.exp(np.minimum(mass[:, None] + score, 0))
            for s, k in gold:
                p[s, k] -= 1
            np.add.at(pull, rows_, p)
        grad = -decay * w * len(rows) - pull.T @ x
        step += grad**2
        w += rate * grad / np.sqrt(step)
    return Field(w, number, none_bound(w, number) > 0)


def none_bound(w: np.ndarray, number: dict[str, int]) -> float:
    """The highest score that any segment of no form can have: its best value of each feature."""
    of = lambda start: [w[:, i] for f, i in number.items() if f.startswith(start)]
    top = lambda values: np.max(values, axis=0) if values else np.zeros(len(w))
    fixed = sum((w[:, number[f]] for f in ("1", "form=none") if f in number), np.zeros(len(w)))
    # an unseen value of a feature adds nothing
    best = fixed + sum(np.maximum(top(of(start)), 0) for start in ("none digits=", "none spaces=")) + np.maximum(top([w[:, i] for f, i in number.items() if f.startswith("glued=") and f.endswith("True")]), 0)
    return float((best + sum((np.maximum(c, 0) for c in of("cue=")), np.zeros(len(w)))).max())


def all_spans(text: str, model: Field, fixed: list[Span] | None = None) -> list[Span]:
    """Fixed spans, and the random field's that touch none of them."""
    fixed = fixed_spans(text) if fixed is None else fixed
    taken: list[list[int]] = []  # fixed spans joined where they overlap
    for b, e in sorted((b, e) for _, b, e in fixed):
        if taken and b < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([b, e])
    added, at = [], 0
    for kind, b, e in model.spans(text):
        while at < len(taken) and taken[at][1] <= b:
            at += 1
        if at == len(taken) or taken[at][0] >= e:
            added.append((kind, b, e))
    return sorted([*fixed, *added], key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, b, e in spans:
        if b >= at:
            out += [text[at:b], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (fixed spans), base_sha256, spans (all), n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in it:
            rows = []
            for t in b.column(1).to_pylist():
                fixed = fixed_spans(t or "")
                every = all_spans(t or "", model, fixed)
                n = [sum(s[0] == k for s in fixed) for k in KINDS[:4]]
                rows.append([*n, hashlib.sha256(joined(fixed).encode()).hexdigest(), joined(every), len(every) - len(fixed)])
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with personal data masked; n_chars, where there is one, counts the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    names = docs.columns
    at = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in it:
            new = [t if t is None else mask(t, all_spans(t, model)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)
    return out
