"""Personal data: e-mail addresses, IPv4 addresses, card and phone numbers, plain and in disguise.

Plain ("base") spans are the leftmost, non-overlapping matches of each kind's rule that pass its test. For disguised ones a
transducer reads the text once and writes a normalised copy: look-alike and full-width characters become ASCII, invisible
characters go, spelled digits become digits, "(at)" and " dot " become signs. It keeps, for every character written, the
source characters that it stands for. The same rules then run over the copy, and a hit that rests on a rewritten character is
mapped back to the source. A disguised span that a plain one of its kind covers wholly is dropped; plain spans always stay.

A bare " at " counts only where a spelled or bracketed dot and a top-level name follow in the same address, so prose is left alone:
any two letters or a common longer name. Names that are also words ("in", "me", "live") count only at the end of a clause, unless
they are the usual ones of an address ("de", "it"). Spelled digits count only within a run that passes the rule of its kind.

Each rule is linear in the text: an address is sought from its "@" or " at " and walked label by label, a run of digits is entered
at its first digit, a run of white space at its first character, and plain words are stepped over whole. Very long texts are
therefore read whole in time in proportion to their length.

Defined results: a null text is an empty one and has no spans; positions are code points, end exclusive; equal rows have equal
results; an empty table gives no row; rows travel in a struct, so columns of any name may clash with none. Redaction replaces merged spans; a null text stays null.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightgrid.llm.common import lean, ready, text_slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alikes of ASCII characters, spelled digits in four languages, disguises of @ and the dot.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a",
    "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "ı": "i", "ɑ": "a",
    "ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "\xa0": " ",
    " ": " ", " ": " ", "　": " ", "﹫": "@",
}
_INVISIBLE = "­᠎​‌‍⁠﻿"
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5",
    "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5",
    "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_AT, _DOT, _PLUS = ("at", "arroba", "arobase", "klammeraffe"), ("dot", "punkt", "punto", "point"), ("plus",)


def _fold() -> dict[str, str]:
    """Look-alikes, and by rule the full-width forms and the digits of every script and style."""
    import sys
    import unicodedata

    out = dict(_LOOK_ALIKES)
    out.update({chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)})
    for c in range(0x80, sys.maxunicode + 1):
        if chr(c) not in out and unicodedata.category(chr(c)) == "Nd":
            out[chr(c)] = str(unicodedata.digit(chr(c)))
    for c in range(0x1D400, 0x1D7CE):  # mathematical letters
        plain = unicodedata.normalize("NFKC", chr(c))
        if plain.isascii() and plain.isalpha():
            out[chr(c)] = plain
    return out


FOLD = _fold()
_AT_RULE, _DOT_RULE = "|".join(_AT), "|".join(_DOT)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_DOT = rf"(?:(?<!\s)\s++)?{_OPEN}\s*+(?:{_DOT_RULE}|\.)\s*+{_CLOSE}\s*+"
_LABEL = r"[^\s@\[\](){}<>.,;:]++"
_STEP = re.compile(rf"{_LABEL}(?:\.|(?P<hidden>\s++(?:{_DOT_RULE})\s++|{_BRACKET_DOT}))", re.IGNORECASE)
# Top-level names that count anywhere, and those of two letters that are words of the languages of the tables.
_TOP = ("com|org|net|edu|gov|mil|int|info|biz|mobi|coop|aero|museum|xyz|io|dev|app|eu|uk|de|fr|es|it|nl|ch|at|pl|se|ca|au|jp|br|ru|cn|mx|ar"
        "|example|test|invalid")
_WORDS = ("ab|al|am|an|as|au|be|by|ce|da|do|du|el|em|en|er|et|go|ha|he|hi|if|il|im|in|is|ja|je|la|le|lo|ma|me|mi|my|ne|ni|no|ob|of|oh|ok|on|or|os"
          "|ou|sa|si|so|su|ta|te|to|tu|um|un|up|us|va|we|wo|ya|yo|zu")
_LATE = f"{_WORDS}|name|pro|jobs|travel|online|site|shop|store|live|news|world|email|cloud|tech|blog"
_ENDS = re.compile(rf"(?:(?:{_TOP})|(?!(?:{_WORDS})\b)[a-z][a-z]|(?:{_LATE})(?=\s*+(?:\Z|[^\w\s])))\b", re.IGNORECASE)
_SIGNS = {"at": "@", "bare": "@", "dot": ".", "plus": "+", "gone": ""}
_PLUS_RULE = rf"(?:{'|'.join(_PLUS)})\s++(?=\w)"
_DISGUISE = re.compile(
    rf"(?P<run>(?!{_PLUS_RULE})\w++|[\x09-\x0D\x20]++(?!{_OPEN}|{_AT_RULE}|{_DOT_RULE}|\s))"  # a word, or white space before no disguise
    rf"|(?P<at>(?:(?<!\s)\s++)?{_OPEN}\s*+(?:{_AT_RULE}|a|@)\s*+{_CLOSE}\s*+)"
    rf"|(?P<bare>(?P<word>(?<!\s)\s++(?:{_AT_RULE}))\s++)"
    rf"|(?P<dot>{_BRACKET_DOT}|(?<=\w)\s++(?:{_DOT_RULE})\s++(?=\w))"
    rf"|(?P<plus>{_PLUS_RULE})"
    rf"|(?P<gone>[{_INVISIBLE}])"
    rf"|(?P<fold>[{re.escape(''.join(sorted(c for c in FOLD if not c.isalnum())))}])"
    rf"|(?P<rest>[\x09-\x0D\x20]++)", re.IGNORECASE)


def _address_follows(text: str, at: int) -> bool:
    """Whether labels with dots between them start at ``at``, one dot at least in disguise, and after it a top-level name."""
    hidden = False
    while not (hidden and _ENDS.match(text, at)):
        step = _STEP.match(text, at)
        if not step:
            return False
        hidden = hidden or step.lastgroup is not None
        at = step.end()
    return True


def _hint() -> str:
    """The gate of ``disguised`` (RE2, as Arrow runs it), from the tables that the transducer reads: it lets every text through
    whose copy can have a sign @, a dotted address of four numbers or ten digits in a row, however they are disguised.
    """
    def points(chars) -> str:
        return "".join(rf"\x{{{ord(c):x}}}" for c in sorted(chars))

    def words(known) -> str:  # Python takes a dotted or dotless i for an i where case does not count
        return "|".join(sorted(known, key=len, reverse=True)).replace("i", "[iİı]")

    def like(signs: str) -> str:
        return points({*signs, *(c for c, new in FOLD.items() if new in signs)})

    space = "[" + points(chr(c) for c in range(0x3001) if chr(c).isspace()) + "]"
    at = rf"{_OPEN}{space}*(?:{words(_AT)}|a|@){space}*{_CLOSE}"
    dot = rf"(?:{space}*{_OPEN}{space}*(?:{words(_DOT)}|\.){space}*{_CLOSE}{space}*|{space}+(?:{words(_DOT)}){space}+)"
    gone = f"[{points(_INVISIBLE)}]*"
    digit = rf"(?:[{like('0123456789')}]|{words(_SPELLED)})"
    number = rf"(?:{digit}{gone})+"
    row = rf"{digit}(?:(?:[{like(' ().-')}{points(_INVISIBLE)}]|{dot})*{digit}){{9}}"
    return rf"(?i)[{like('@')}]|{at}|{dot}|(?:{number}(?:[{like('.')}]|{dot}){gone}){{3}}{digit}|{row}"


HINT = _hint()
BASE_HINT = "[@0-9]"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = max(last, at + 1)  # no later match can reach over this sign
        at = text.find("@", last)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every plain span, by start and then kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def normalise(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The normalised copy and its rewritten places: (place in the copy, source start, source end, width written), in order."""
    out, moves, at, size, seek = [], [], 0, 0, 0

    def rewrite(start: int, end: int, new: str) -> None:
        nonlocal at, size
        size += start - at
        moves.append((size, start, end, len(new)))
        out.extend((text[at:start], new))
        size += len(new)
        at = end

    def fold(start: int, end: int) -> None:
        for k in range(start, end):
            if text[k] in FOLD:
                rewrite(k, k + 1, FOLD[text[k]])

    while seek < len(text):
        for m in _DISGUISE.finditer(text, seek):
            kind = m.lastgroup
            if kind == "run":
                run = m.group()
                digit = _SPELLED.get(run.casefold())
                if digit:
                    rewrite(m.start(), m.end(), digit)
                elif not run.isascii():
                    fold(m.start(), m.end())
            elif kind == "bare" and not _address_follows(text, m.end()):
                fold(m.start(), m.end("word"))
                seek = m.end("word")  # the white space behind the word may begin a disguise
                break
            elif kind == "fold":
                fold(m.start(), m.end())
            elif kind != "rest":
                rewrite(*m.span(), _SIGNS[kind])
        else:
            break
    out.append(text[at:])
    return "".join(out), moves


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans of the source that only the normalised copy shows."""
    import bisect

    copy, moves = normalise(text)
    if not moves:
        return []
    places, out = [m[0] for m in moves], []

    def source(k: int) -> tuple[int, int]:
        """Source start and end of the copy's character ``k``."""
        j = bisect.bisect_right(places, k) - 1
        if j < 0:
            return k, k + 1
        place, start, end, width = moves[j]  # of several at one place the last: invisible ones before it wrote nothing
        if k < place + width:
            return start, end
        return end + k - place - width, end + k - place - width + 1

    for kind, start, end in find(copy):
        if bisect.bisect_left(places, start) < bisect.bisect_left(places, end):
            out.append((kind, source(start)[0], source(end - 1)[1]))
    return out


def spans_of(text: str, look: bool = True) -> tuple[list, list]:
    """(plain spans, all spans) of a text; ``look`` says whether it may hold a disguise."""
    import bisect

    base, extra = find(text), []
    of_kind = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}
    for kind, start, end in disguised(text) if look else []:
        before = bisect.bisect_right(of_kind[kind], (start, len(text) + 1)) - 1  # plain spans of a kind don't overlap: one can cover it
        if before < 0 or of_kind[kind][before][1] < end:
            extra.append((kind, start, end))
    both = sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return base, both


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first, in capitals and brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _finder(keep: list[str]):
    def run(batches):
        import pyarrow.compute as pc

        from sightgrid.llm import pii

        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            row = batch.column(0)
            flat = pa.RecordBatch.from_arrays([row.field("text").cast(pa.large_string())], ["text"])
            at = 0
            for part in text_slices(flat):
                texts, here = part.column("text"), row.slice(at, part.num_rows)
                at += part.num_rows
                look, plain = (pc.match_substring_regex(texts, h).to_pylist() for h in (pii.HINT, pii.BASE_HINT))
                counts, digests, spans, clean = {k: [] for k in KINDS}, [], [], []
                for k in range(len(texts)):
                    base, both, text = (), (), None
                    if look[k] or plain[k]:
                        text = texts[k].as_py()
                        base, both = pii.spans_of(text, look[k])
                    for kind in KINDS:
                        counts[kind].append(sum(s[0] == kind for s in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else nothing)
                    spans.append(joined(both))
                    clean.append(pii.redact(text, both) if both else None)
                kept = pa.StructArray.from_arrays([here.field(c) for c in keep], fields=[row.type.field(c) for c in keep])
                yield pa.RecordBatch.from_arrays(
                    [kept, *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()),
                     pa.array(spans, pa.string()), pa.array(clean, pa.string())],
                    ["row", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"])

    return run


def personal_data(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (struct of the columns ``keep``), counts and digest of the plain spans, all spans and, where there are any, the redacted text."""
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])),
                           *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           *[T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "redacted")]])
    need = list(dict.fromkeys([*keep, "text"]))
    return ready(docs).select(F.struct(*need).alias("row")).mapInArrow(lean(_finder(keep)), schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (and ``n_chars`` counted anew where that column is there)."""
    out = personal_data(docs, docs.columns)
    text = F.coalesce("redacted", "row.text")
    new = {"text": text, "n_chars": F.when(F.col("redacted").isNotNull(), F.length("redacted").cast(docs.schema["n_chars"].dataType))
           .otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
