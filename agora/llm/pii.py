"""Personal data with offset-preserving deobfuscation (operator 3).

Base identifiers are found in the source text. Then transducers rewrite the text and carry, for
each character they write, the source range it came from:

1. characters: homoglyphs, full-width and other digit forms, dashes and spaces become ASCII,
   invisible characters vanish;
2. digits spelled as words (three or more in a row, also among written ones) become digits, a
   leading "plus" becomes "+" and a "dot" between them ".";
3. "(at)", "[dot]" and the like, and "name at host dot tld", become "@" and "."; words of the
   corpus's other languages count too ("arroba", "punto", "punkt", "point"). A disguised host has
   at most 127 labels of at most 63 characters, the limits of DNS; names have no limit.

The same detectors run over the rewritten text, and their spans are mapped back to the source. A
mapped span is added if its source differs from what it was rewritten to (so clean text gains
nothing) and no base span has the same kind and place. A run of 10 to 15 digits with spelled ones
in it, and at least three different digits, is also a phone number without "+".

All scans are linear in the text. Defined results: null is the empty text; overlapping spans of
different kinds all stay; equal rows give equal results.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agora.llm.common import map_batches, texts

#: Code points of a text whose words are looked through at a time.
WINDOW = 1 << 20
#: Pieces of a rewritten text that are held singly.
EDITS = 1 << 16
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """A local part has no "@", so each match ends its local part at an "@"; only the stretch
    since the last "@" or match can hold it."""
    since, at = 0, text.find("@")
    while at >= 0:
        stretch = text[since:at]
        start = since + len(stretch.rstrip(_LOCAL))
        since = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            since = domain.end()
        at = text.find("@", since)


def addresses(text: str) -> Iterator[Span]:
    """Four dotted numbers: within a maximal dotted chain, matches take four numbers at a time."""
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, place = chain[0].split("."), chain.start()
        for i in range(0, len(parts), 4):
            four = parts[i:i + 4]
            end = place + sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield place, end
            place = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


DETECTORS: dict[str, Callable[[str], Iterator[Span]]] = {
    "email": emails, "ip": addresses, "card": cards, "phone": phones}


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base identifiers, by start and then kind."""
    found = []
    digits = bool(_DIGIT.search(text))
    for kind in KINDS:
        if kind == "email" or digits:
            found += [(s, e, kind) for s, e in DETECTORS[kind](text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# ------------------------------------------------------------------ transducers

#: Letters of other scripts and the ASCII letters they look like (fixed values).
LOOKALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "κк", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝω",
    "x": "хχ", "y": "уγү", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "-": "‐‑‒–—―−", ".": "․。｡", "@": "﹫＠", "+": "＋",
}
#: Characters that show nothing (fixed values): soft hyphen, zero-width ones, word joiner, BOM.
INVISIBLE = "­​‌‍⁠﻿"
#: The characters of Latin-1 that are rewritten; its letters and other signs are ordinary text.
LATIN_1 = "\xa0²³¹"
#: Words for the digits 0 to 9 in the corpus's languages (fixed values).
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)


def _to_ascii() -> dict[int, str]:
    """One ASCII character for each look-alike and each character whose compatibility form is one."""
    table = {ord(c): a for a, others in LOOKALIKES.items() for c in others}
    for code in (*map(ord, LATIN_1), *range(0x100, sys.maxunicode + 1)):
        if 0xAC00 <= code <= 0xDFFF or code in table:
            continue
        char = chr(code)
        if unicodedata.category(char) == "Nd":
            table[code] = str(unicodedata.digit(char))
        elif unicodedata.decomposition(char).startswith("<") and len(form := unicodedata.normalize("NFKC", char)) == 1 and form.isascii():
            table[code] = form
    return table


class _Tables:
    """Built once per worker on first use."""

    def __init__(self) -> None:
        self.ascii = _to_ascii()
        self.odd = frozenset(map(chr, self.ascii)) | frozenset(INVISIBLE)
        self.digit = {w: str(d) for words in DIGIT_WORDS for d, w in enumerate(words.split())}
        word = "(?:" + "|".join(sorted(self.digit, key=len, reverse=True)) + ")"
        gap, item = r"[\s,.()–-]{1,3}", rf"(?:{word}|[0-9]+)(?!\w)"
        self.spelled = re.compile(rf"(?<!\w)(?:plus{gap}|\+\s?\(?)?{item}(?:(?:{gap}(?:dot|point))?{gap}{item})+", re.I)
        self.tokens = frozenset(w + mark for w in self.digit for mark in ("", ",", ".", ";", "-"))


_tables: _Tables | None = None


def tables() -> _Tables:
    global _tables
    if _tables is None:
        _tables = _Tables()
    return _tables


#: Last labels of hosts (fixed values): general and country ones, and those that are words as well.
ENDINGS = frozenset((
    "com org net edu gov mil int info biz aero coop example io ai tv xyz test "
    "ac ad ae af ag al ao aq ar au aw ax az ba bb bd bf bg bh bi bj bm bn bo br bs bt bw bz ca cc cd cf cg ch ci ck cl cm "
    "cn co cr cu cv cw cx cy cz de dj dk dm dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr "
    "gs gt gu gw gy hk hm hn hr ht hu ie il im iq ir je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu "
    "lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx mz na nc ne nf ng ni nl np nr nu nz om pa pe pf pg ph pk "
    "pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj "
    "tk tl tm tn tr tt tw tz ua ug uk uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw").split())
WORDY = frozenset((
    "in it is to at be me no so am my us as do by id academy accountant accountants actor adult africa agency amsterdam "
    "apartments app art asia associates auction audio auto autos baby band bank bar barcelona bargains bayern beauty beer "
    "berlin best bet bid bike bingo bio black blog blue boats bond book boutique broker brussels build builders business buzz "
    "cab cafe cam camera camp capital car cards care careers cars casa cash casino cat catering center ceo chat cheap "
    "christmas church city claims cleaning click clinic clothing cloud club coach codes coffee college cologne community "
    "company computer condos construction consulting contact contractors cooking cool country coupons courses credit "
    "creditcard cricket cruises dance data date dating day deals degree delivery democrat dental dentist design dev diamonds "
    "diet digital direct directory discount doctor dog domains download earth eco education email energy engineer engineering "
    "enterprises equipment estate events exchange expert exposed express fail faith family fan fans farm fashion finance "
    "financial fish fishing fit fitness flights florist flowers football forex forsale forum foundation fun fund furniture "
    "futbol fyi gallery game games garden gay gent gifts gives glass global gmbh gold golf graphics gratis green gripe group "
    "guide guitars guru hair hamburg haus health healthcare help hiphop hockey holdings holiday homes horse hospital host "
    "hosting hotel house how immo immobilien inc industries ink institute insurance insure international investments irish "
    "istanbul jetzt jewelry jobs juegos kaufen kim kitchen kiwi koeln land lat law lawyer lease legal life lighting limited "
    "limo link live llc loan loans lol london love ltd luxe luxury madrid maison management market marketing markets mba media "
    "melbourne memorial men menu miami mobi moda moe mom money monster mortgage moscow movie museum music name navy network "
    "new news ngo ninja nyc one ong online organic page paris partners parts party pet pharmacy phd photo photography photos "
    "physio pics pictures pink pizza place plumbing plus poker porn post press pro productions promo properties property pub "
    "quebec racing realty recipes red rehab reise reisen rent rentals repair report republican rest restaurant review reviews "
    "rich rio rip rocks rodeo run saarland sale salon sarl school schule science security services sex shoes shop shopping "
    "show singles site ski skin soccer social software solar solutions soy space sport storage store stream studio study style "
    "supplies supply support surf surgery swiss sydney systems tattoo tax taxi team tech technology tel tennis theater theatre "
    "tickets tienda tips tires tirol today tokyo tools top tours town toys trade trading training travel tube university uno "
    "vacations vegas ventures vet viajes video villas vin vip vision vodka vote voting voto voyage wales wang watch webcam "
    "website wedding wien wiki win wine work works world wtf yachts yoga yokohama zone").split())
#: Words that are no host before a last label that is a word, and no names in front of "at".
_NO_HOST = frozenset("the a an this that these those some any one what which each every no my your his her its our their".split())
_NO_NAME = frozenset("us me him her them it you me uns mich nous moi nos".split())
_ROLE = frozenset("info webmaster postmaster kontakt contacto noreply admin hello".split())
_CUE = re.compile(r"(?:\be-?mail|\bmail(?:to)?|\bcontact|\bkontakt|\bcorreo|\bcourriel|\bwrite to)\s?:?\s?$", re.I)
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
#: Characters before a name in which a word for mail or the start of a spoken name is looked for.
NEARBY = 48
_GAP = r"(?:\s{1,3}|_)"
_AT_WORD, _DOT_WORD = r"(?:at|@|arroba|arobase?)", r"(?:dot|\.|punkt|punto|point)"
_SEPARATOR = rf"(?:\.|{_GAP}(?:dot|punkt|punto|point){_GAP}|{_OPEN}{_DOT_WORD}{_CLOSE})"
_LABEL = "[A-Za-z0-9-]{1,63}"
_SPLIT = re.compile(_SEPARATOR, re.I)
#: "at" as a sign, in brackets or bare; the latter and "@" with what can be a host behind them.
_AT_SIGN = re.compile(
    rf"(?P<sign>{_OPEN}{_AT_WORD}{_CLOSE}|@)(?P<host>{_LABEL}(?:{_SEPARATOR}{_LABEL}){{1,126}})?|"
    rf"(?<=[A-Za-z0-9])(?P<bare>{_GAP}(?:at|arroba|arobase?){_GAP})(?P<to>{_LABEL}(?:{_SEPARATOR}{_LABEL}){{1,126}})", re.I)
_BRACKETS = re.compile(rf"{_OPEN}(?:{_AT_WORD}|{_DOT_WORD}){_CLOSE}", re.I)
_BARE = re.compile(rf"(?<=[A-Za-z0-9]){_GAP}(?:at|arroba|arobase?){_GAP}{_LABEL}{_SEPARATOR}[A-Za-z]|@{_LABEL}{_GAP}(?:punkt|punto|point)\b", re.I)
_DOT_SIGN = re.compile(rf"{_OPEN}{_DOT_WORD}{_CLOSE}|(?<=[A-Za-z0-9]){_GAP}dot{_GAP}(?=[A-Za-z0-9])", re.I)
_SPOKEN = re.compile(rf"{_GAP}dot{_GAP}", re.I)
_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_SPOKEN_NAME = re.compile(rf"[A-Za-z0-9]{_GAP}(?:dot|punkt|punto){_GAP}[A-Za-z0-9-]+\Z", re.I)
_MIXED = re.compile(r"[a-z][0-9]|[0-9][a-z]", re.I)


def _is_host(before: str, separators: list[str], labels: list[str], sign: bool) -> bool:
    """Whether "at" between ``before`` and these labels makes an address; ``sign``: it is in
    brackets or "@". The endings known are enough for a host with a disguised dot. Others need a
    name or host that looks like an address; real dots need such a name, or a word for mail."""
    host, end = [x.lower() for x in labels[:-1]], labels[-1].lower()
    if not (2 <= len(end) <= 24 and end.isalpha()) or host[0] == "www":
        return False
    found = _NAME.search(before)
    name = found[0].strip(".") if found else ""
    dotted = any(c in name for c in "._+") or bool(_SPOKEN_NAME.search(before))
    like = dotted or bool(_MIXED.search(name))
    known = end in ENDINGS or end in WORDY
    if all(x == "." for x in separators):
        cue = name.lower() not in _NO_NAME and _CUE.search(before[:found.start()]) if found else None
        return known and (labels[-1].islower() or labels[-1].isupper()) and bool(like or name.lower() in _ROLE or cue)
    if end in ENDINGS:
        return True
    if len(host) == 1 and host[0] in _NO_HOST:
        return False
    if any("point" in x.lower() for x in separators):
        return known and (dotted or sign or len(host) > 1)
    return known or like or sign or len(host) > 1 or any("-" in x or _MIXED.search(x) for x in host)


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, new) of the "at" that are signs and of the dots in words of their hosts."""
    place = 0
    while m := _AT_SIGN.search(text, place):
        sign = m["bare"] is None
        here, host = ("sign", "host") if sign else ("bare", "to")
        place = m.end(here)
        dots: list[tuple[int, int]] = []
        if m[host] is not None:
            dots = [(m.start(host) + d.start(), m.start(host) + d.end()) for d in _SPLIT.finditer(m[host])]
            marks = [m.start(host), *(x for d in dots for x in d), m.end(host)]
            labels = [text[x:y] for x, y in zip(marks[0::2], marks[1::2])]
            name = m.start()
            while name and text[name - 1] in _LOCAL:
                name -= 1
            before = text[max(0, name - NEARBY):m.start()]
            while dots:  # the longest host that makes an address
                end = marks[2 * len(dots) + 1]
                after = text[end:end + 1]
                if not (after == "-" or after.isalnum() or after == "_" and len(dots) == len(labels) - 1) and _is_host(
                        before, [text[x:y] for x, y in dots], labels[:len(dots) + 1], sign):
                    break
                dots.pop()
        if sign and m["sign"] != "@" or dots:
            if m[here] != "@":
                yield m.start(here), m.end(here), "@"
            for x, y in dots:
                if y - x > 1:
                    yield x, y, "."
                place = y


class Mapped:
    """A rewritten text; character i came from source[start[i]:end[i]]. The maps are integer arrays."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + np.int32(1)
        self.spelled = np.zeros(0, bool)  # whether a source place begins a spelled digit

    def rewrite(self, pattern: re.Pattern, new: str) -> None:
        """Replace every match by ``new``."""
        self.edit((*m.span(), new) for m in pattern.finditer(self.text))

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace ascending ranges (start, end, new); all of ``new`` comes from the whole range."""
        pieces, kept, last = [], [], 0
        for a, b, new in edits:
            if last < a:
                pieces.append(self.text[last:a])
                kept.append((self.start[last:a], self.end[last:a]))
            if new:
                pieces.append(new)
                kept.append((np.full(len(new), self.start[a]), np.full(len(new), self.end[b - 1])))
            last = b
            if len(kept) > EDITS and len(pieces) > EDITS:  # many small pieces become one
                pieces, kept = ["".join(pieces)], [tuple(np.concatenate(x) for x in zip(*kept))]
        if last:
            pieces.append(self.text[last:])
            kept.append((self.start[last:], self.end[last:]))
            self.text = "".join(pieces)
            self.start, self.end = (np.concatenate(x) for x in zip(*kept))


def _has_odd(text: str, odd: frozenset[str]) -> bool:
    """Whether a transducer of characters applies."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not odd.isdisjoint(text)
    return any(c in text for c in LATIN_1 + "\xad")


def _has_digit_word(low: str, tokens: frozenset[str]) -> bool:
    """Whether a digit is spelled anywhere; looked for in overlapping windows of the text."""
    for a in range(0, max(len(low), 1), WINDOW):
        part = low[a:a + WINDOW + 64]
        words = set(part.split())
        if not words.isdisjoint(tokens) or "-" in part and any("-" in w and not tokens.isdisjoint(w.split("-")) for w in words):
            return True
    return False


_TOKEN = re.compile(r"\w+|\+")


def _spelled_digits(out: Mapped, t: _Tables) -> Iterator[tuple[int, int, str]]:
    """Edits that write digits for digit words: each word keeps its own range, separators go."""
    for m in t.spelled.finditer(out.text):
        if sum(1 for w in _TOKEN.finditer(m[0]) if w[0].lower() in t.digit) < 3:
            continue
        last = m.start()
        for w in _TOKEN.finditer(m[0]):
            a, b, word = m.start() + w.start(), m.start() + w.end(), w[0].lower()
            if last < a:
                yield last, a, ""
            if word in t.digit:
                out.spelled[out.start[a]] = True
            new = "+" if word in ("plus", "+") else "." if word in ("dot", "point") else t.digit.get(word)
            if new is not None and new != out.text[a:b]:
                yield a, b, new
            last = b
        if last < m.end():
            yield last, m.end(), ""


def deobfuscate(text: str) -> Mapped | None:
    """The rewritten text, or None if no transducer applies."""
    t = tables()
    odd = _has_odd(text, t.odd)
    plain = text.translate(t.ascii) if odd else text
    low = plain.lower()
    brackets = any(c in low for c in "[({<") and _BRACKETS.search(low)
    spoken = "dot" in low and _SPOKEN.search(low) or _BARE.search(low)
    spelled = _has_digit_word(low, t.tokens) and t.spelled.search(low)
    del low
    if not (odd or brackets or spoken or spelled):
        return None
    out = Mapped(text)
    if odd:
        out.text = plain  # one character for one
        out.rewrite(re.compile(f"[{INVISIBLE}]+"), "")

    if spelled:
        out.spelled = np.zeros(len(text), bool)
        out.edit(_spelled_digits(out, t))
    out.edit(_signs(out.text))
    out.rewrite(_DOT_SIGN, ".")
    return out


_DIGIT_RUN = re.compile("[0-9]+")


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: (start, end, kind) by start and then kind."""
    base = detect(text)
    seen = deobfuscate(text)
    if seen is None:
        return base, base
    got = detect(seen.text)
    if len(seen.spelled):
        taken = np.zeros(len(seen.text), bool)
        for s, e, _ in got:
            taken[s:e] = True
        for m in _DIGIT_RUN.finditer(seen.text):
            if (10 <= m.end() - m.start() <= 15 and not taken[m.start()] and len(set(m[0])) > 2
                    and seen.spelled[seen.start[m.start():m.end()]].any()):
                got.append((*m.span(), "phone"))
    known, more = set(base), []
    for s, e, kind in got:
        span = (int(seen.start[s]), int(seen.end[e - 1]), kind)
        alike = kind in ("card", "phone") and len(set(_DIGIT.findall(seen.text[s:e]))) < 2  # one word again and again
        if span not in known and not alike and text[span[0]:span[1]] != seen.text[s:e]:
            known.add(span)
            more.append(span)
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, the number of base spans by kind (``n_email``,
    ``n_ip``, ``n_card``, ``n_phone``), ``base`` and ``spans`` (the base spans and all spans,
    each as kind:start:end in code points, comma-joined) and ``n_added``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in KINDS]
        base_texts, span_texts, added = [], [], []
        for text in batch.column(1):
            base, spans = find(text.as_py())
            for kind, column in zip(KINDS, counts):
                column.append(sum(k == kind for _, _, k in base))
            base_texts.append(written(base))
            span_texts.append(written(spans))
            added.append(len(spans) - len(base))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_texts, pa.string()),
             pa.array(span_texts, pa.string()), pa.array(added, pa.int64())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"])

    return map_batches(texts(docs), run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, "
                       "n_phone bigint, base string, spans string, n_added bigint")
