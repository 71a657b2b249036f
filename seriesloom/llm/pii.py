"""Personal data: offset-preserving deobfuscation in front of plain detectors.

Detectors for e-mail addresses, IPv4 addresses, card numbers and telephone numbers run over the
text as it is. Where a text holds disguised characters, transducers rewrite it as well: look-alike
letters and digits become ASCII, invisible characters go, "[at]" and "(dot)" and spelled-out
separators become signs, runs of spelled digits become digits. Every rewritten character keeps the
source range it came from, so what the detectors find in the rewritten text maps back to offsets in
the source.

Defined cases: a null text counts as empty; an empty text has no spans; equal rows give equal rows;
a table without rows gives none; all other columns of the input are ignored by ``find`` and kept by
``mask``. Work is linear in a text's length, and a task holds one text at a time.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Out, rows, sha256_hex

KINDS = ("email", "ip", "card", "phone")
ORDER = {kind: i for i, kind in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A number that starts inside a longer one has the same continuation, so only whole ones are tried.
IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", re.S)
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @ backwards: linear also in long words."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain identifiers, by start and then kind."""
    found = []
    if "@" in text:
        found += [(s, e, "email") for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 9 else not p.strip("0") or int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]], x[1]))


# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = dict(
    zip("аеорсухіјѕԁһАВЕКМНОРСТХУІЈЅоΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdhABEKMHOPCTXYIJSoABEZHIKMNOPTYXo", strict=True)
)
INVISIBLE = "​‌‍⁠﻿­"
SPELLED = {
    w: str(d)
    for d, group in enumerate(
        (
            "zero oh null cero zéro",
            "one eins uno un",
            "two zwei dos deux",
            "three drei tres trois",
            "four vier cuatro quatre",
            "five fünf cinco cinq",
            "six sechs seis",
            "seven sieben siete sept",
            "eight acht ocho huit",
            "nine neun nueve neuf",
        )
    )
    for w in group.split()
}
WORDS = "|".join(sorted(map(re.escape, SPELLED), key=len, reverse=True))
OPEN, CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
STRANGE = r"­Ͱ-ϿЀ-ԯ​-‍⁠﻿！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff‐-―−"
SPACED_DOT = r"\s(?:dot|punkt|punto)\s"
SAID = rf"\b(?:plus[\s-])?(?:{WORDS})(?:[\s.-]{{1,2}}(?:{WORDS}|[0-9])){{2,}}\b"
# Each alternative is one transducer; what none of them takes is copied.
RULES = re.compile(
    rf"(?P<at>\s{{0,2}}{OPEN}(?:at|arroba|@){CLOSE}\s{{0,2}})"
    rf"|(?P<dot>\s{{0,2}}{OPEN}(?:dot|punkt|point|punto|\.){CLOSE}\s{{0,2}})"
    rf"|(?P<bare>(?<=[A-Za-z0-9])\s(?:at|arroba)\s(?=[A-Za-z0-9-]{{1,63}}(?:{SPACED_DOT}[A-Za-z0-9-]{{1,63}})+))"
    rf"|(?P<baredot>(?<=[A-Za-z0-9]){SPACED_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<digits>{SAID})"
    rf"|(?P<strange>[{STRANGE}])",
    re.I,
)
# The gate: every text that a rule matches in matches one of these, which share the rules' parts.
ODD = re.compile(rf"[{STRANGE}]", re.I)
BRACKETED = re.compile(rf"{OPEN}(?:at|arroba|dot|punkt|point|punto|@|\.){CLOSE}", re.I)
SEPARATED = re.compile(SPACED_DOT, re.I)
SPOKEN = re.compile(SAID, re.I)


def hinted(text: str) -> bool:
    """Whether a rule could apply; never False where one does."""
    if not text.isascii() and ODD.search(text) or BRACKETED.search(text):
        return True
    low = text.lower()
    if ("dot" in low or "punkt" in low or "punto" in low) and SEPARATED.search(text):
        return True
    return SPOKEN.search(text) is not None


PART = re.compile(rf"plus(?=[\s-])|{WORDS}|[0-9]", re.I)


@lru_cache(4096)
def plain(ch: str) -> str:
    """ASCII form of one disguised character; invisible ones vanish."""
    if ch in INVISIBLE:
        return ""
    if ch in LOOKALIKE:
        return LOOKALIKE[ch]
    if unicodedata.category(ch) == "Pd" or ch == "−":
        return "-"
    if (d := unicodedata.digit(ch, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() else ch


def rewrite(text: str) -> tuple[str, list[tuple[int, int, int, bool]]] | None:
    """The normalised text and its runs (start there, start and end in the source, copied?).

    None where no rule applies.
    """
    if not hinted(text):
        return None
    parts: list[str] = []
    runs: list[tuple[int, int, int, bool]] = []
    size = done = 0

    def put(made: str, start: int, end: int, copied: bool) -> None:
        nonlocal size
        if made:
            parts.append(made)
            runs.append((size, start, end, copied))
            size += len(made)

    for m in RULES.finditer(text):
        put(text[done : m.start()], done, m.start(), True)
        done = m.end()
        if m["at"] or m["bare"]:
            put("@", m.start(), m.end(), False)
        elif m["dot"] or m["baredot"]:
            put(".", m.start(), m.end(), False)
        elif m["digits"]:
            for p in PART.finditer(text, m.start(), m.end()):
                low = p[0].lower()
                put("+" if low == "plus" else SPELLED.get(low, low), p.start(), p.end(), False)
        else:
            put(plain(m[0]), m.start(), m.end(), False)
    put(text[done:], done, len(text), True)
    return "".join(parts), runs


def disguised(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers that show only in the rewritten text, as source spans clear of ``base``."""
    made = rewrite(text)
    if not made:
        return []
    normal, runs = made
    starts = [r[0] for r in runs]
    taken = sorted((s, e) for s, e, _ in base)
    out = []
    for start, end, kind in detect(normal):
        i, j = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        if all(r[3] for r in runs[i : j + 1]) and i == j:
            continue
        first = runs[i][1] + (start - runs[i][0] if runs[i][3] else 0)
        last = runs[j][1] + (end - runs[j][0]) if runs[j][3] else runs[j][2]
        k = bisect_left(taken, (last, -1))
        if not any(e > first for _, e in taken[max(0, k - 4) : k]):
            out.append((first, last, kind))
    return out


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans, and all spans with the disguised ones."""
    base = detect(text or "")
    more = disguised(text or "", base)
    return base, sorted([*base, *more], key=lambda x: (x[0], ORDER[x[2]], x[1])) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FOUND = "doc_id long, base array<struct<start:long,end:long,kind:string>>, spans array<struct<start:long,end:long,kind:string>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(pa.schema([("doc_id", pa.int64()), ("base", SPAN), ("spans", SPAN)]))
    as_rows = lambda spans: [dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans]
    for batch in batches:
        for doc_id, text in rows(batch, "doc_id", "text"):
            base, spans = find_spans(text)
            if out.add(doc_id, as_rows(base), as_rows(spans)):
                yield out.take()
    yield from out.rest()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the plain spans (``base``) and all spans, as offsets in code points."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_find, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind of plain span, and the spans as text."""
    is_kind = lambda kind: lambda s: s.kind == kind
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text("base"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


def _mask(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        made = []
        for cell in batch.column(at):
            text = cell.as_py()
            spans = find_spans(text)[1] if text else []
            if spans:
                parts, done = [], 0
                for start, end, kind in spans:
                    if start >= done:
                        parts += [text[done:start], f"<{kind.upper()}>"]
                    elif end <= done:
                        continue
                    done = max(done, end)
                text = "".join([*parts, text[done:]])
            made.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by the name of its kind; null texts stay null."""
    return docs.mapInArrow(lambda it: _mask(it, text_col), docs.schema)
