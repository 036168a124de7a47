"""Personal data: detection on the text and, offsets preserved, on its deobfuscated form.

The detectors run on the text as it is (the base spans).  Texts that show a
disguise are also rewritten by a transducer whose output pieces keep the source
interval they came from: homoglyphs and full-width forms to ASCII, invisible
characters to nothing, spelled digits to digits, bracketed or spelled-out "at" and
"dot" to their signs.  Detections on the rewritten form map back to source
intervals and are added where no base span of their kind overlaps, or where they
reach further than those do (not to the left over a dash, which prose sets between words).

Edge cases: null texts count as empty; repeated rows give repeated results;
columns beyond the id and the text pass through ``redact`` and are ignored by
``detect``.  Every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import map_in_arrow, released

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Whole runs of digits only, so that no run is tried at each of its places.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: A chain of fewer digits cannot pass, nor can a part of it.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like ASCII ones, by the ASCII letter.
LOOKALIKES = {"a": "аɑα", "c": "сϲ", "e": "е", "h": "һ", "i": "іι", "j": "ј", "o": "оοօ", "p": "рρ", "s": "ѕ", "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "-": "‐‑‒–−", ".": "․。", "@": "﹫", "+": "﹢"}
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

GLYPHS = {c: k for k, cs in LOOKALIKES.items() for c in cs} | {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)} | dict.fromkeys(INVISIBLE, "")
DASH = re.compile("[" + LOOKALIKES["-"] + "]")
GLYPH = re.compile("[" + re.escape("".join(GLYPHS)) + "]")
WORDS = "|".join(SPELLED)
DIGITS = re.compile(rf"(?i)\b(?:{WORDS})(?:[\x20-]{{1,2}}(?:{WORDS}))+\b")
AT = re.compile(r"(?i)\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?")
DOT = re.compile(r"(?i)\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?")
SPOKEN_AT = re.compile(r"(?i)\x20at\x20")
SPOKEN_DOT = re.compile(r"(?i)\x20dot\x20")
#: What may follow an "at", whatever form each of its dots has.
AFTER = re.compile(rf"(?i)[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20|{DOT.pattern[4:]})[A-Za-z0-9-]++)++")
#: Prose says "at site.org" too, so that an "at" as the only disguise needs a name that is no plain word.
NAME = re.compile(r"[A-Za-z0-9%+-]*+[0-9._%+][A-Za-z0-9._%+-]*[A-Za-z0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches found from their signs: the run before each, and the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        last = at + 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def byte(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    d = digits.lstrip("0")
    return len(d) <= 3 and int(d or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(byte(p) for p in m[0].split("."))] if "." in text else []
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Rewritten:
    """A rewritten text whose pieces know their source intervals."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, starts, sources, at, n = [], [], [], 0, 0
        for a, b, new in [*edits, (len(text), len(text), "")]:
            for lo, hi, s, whole in ((at, a, text[at:a], False), (a, b, new, True)):
                if s:
                    parts.append(s)
                    starts.append(n)
                    sources.append((lo, hi, whole))
                    n += len(s)
            at = b
        self.text, self.starts, self.sources = "".join(parts), np.array(starts, np.int64), sources

    def source(self, start: int, end: int) -> tuple[int, int]:
        k, j = (int(np.searchsorted(self.starts, x, side="right")) - 1 for x in (start, end - 1))
        lo, _, whole = self.sources[k]
        lo2, hi2, whole2 = self.sources[j]
        return lo if whole else lo + start - int(self.starts[k]), hi2 if whole2 else lo2 + end - int(self.starts[j])


def _twice(first: list[tuple[int, int, str]], second: list[tuple[int, int, str]], mid: Rewritten) -> list[tuple[int, int, str]]:
    """Both transducers' edits on the source; an edit of the second takes in those of the first that it covers."""
    mapped = [(*mid.source(a, b), new) for a, b, new in second]
    taken, k = [], 0
    for e in first:
        while k < len(mapped) and mapped[k][1] <= e[0]:
            k += 1
        if k == len(mapped) or e[1] <= mapped[k][0]:
            taken.append(e)
    return sorted(taken + mapped)


def spoken(text: str, low: str, ats: list[tuple[int, int]], dots: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Edits of each spoken sign in an address whose other signs may be plain, bracketed or spoken."""
    said = [m.span() for m in SPOKEN_DOT.finditer(text)] if " dot " in low else []
    heard = [m.span() for m in SPOKEN_AT.finditer(text)] if " at " in low else []
    if not said and not heard:
        return []
    out, last, before, heard_at, said_at = [], 0, {b: a for a, b in [*dots, *said]}, set(heard), set(said)
    plain = [(m.start(), m.end()) for m in re.finditer("@", text)] if said else []
    for a, b in sorted({*heard, *ats, *plain}):
        if a < last or a == 0 or text[a - 1] not in LOCAL:
            continue
        m, start, names = AFTER.match(text, b), a, []
        while start > last:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            dot = before.get(start, start)
            if dot <= last or dot == start or text[dot - 1] not in LOCAL:
                break
            names.append((dot, start))
            start = dot
        last = b
        if m is None:
            continue
        signs = [x.span() for x in SPOKEN_DOT.finditer(text, b, m.end())]
        shown = names or signs or DOT.search(text, b, m.end()) or NAME.fullmatch(text, start, a)
        if (a, b) not in heard_at or shown:
            out += [(a, b, "@")] * ((a, b) in heard_at) + [(*x, ".") for x in [*names, *signs] if x in said_at]
        last = m.end()
    return out


def deobfuscate(text: str) -> Rewritten | None:
    """The text without disguises, or None where it shows none."""
    glyphs = [(m.start(), m.end(), GLYPHS[m[0]]) for m in GLYPH.finditer(text)] if not text.isascii() else []
    mid = Rewritten(text, glyphs)
    low, edits = mid.text.lower(), []
    if any(f"{w} " in low or f"{w}-" in low for w in SPELLED):
        for m in DIGITS.finditer(mid.text):
            edits.append((*m.span(), "".join(SPELLED[w] for w in re.split(r"[ -]+", m[0].lower()))))
    if "at" in low or "@" in low:
        ats, dots = ([m.span() for m in sign.finditer(mid.text)] for sign in (AT, DOT))
        signs = [(*x, "@") for x in ats] + [(*x, ".") for x in dots] + spoken(mid.text, low, ats, dots)
        edits += signs
    merged = []
    for e in sorted(edits):
        if not merged or e[0] >= merged[-1][1]:
            merged.append(e)
    if not merged and not glyphs:
        return None
    return Rewritten(text, _twice(glyphs, merged, mid))


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base with added spans, each by kind and start."""
    base = base_spans(text)
    plain = deobfuscate(text)
    if plain is None:
        return base, base
    more = set()
    for kind, a, b in base_spans(plain.text):
        lo, hi = plain.source(a, b)
        over = [(s, e) for k, s, e in base if k == kind and lo < e and s < hi]
        if not over or lo < min(over)[0] and not DASH.search(text, lo, min(over)[0]) or hi > max(e for _, e in over):
            more.add((kind, lo, hi))
    return base, sorted([*base, *more])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256 and spans."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, every = all_spans(text.as_py() or "")
                n = [0] * 4
                for k, _, _ in base:
                    n[k] += 1
                out.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return t.mapInArrow(released(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """Each span, overlapping ones as one, replaced by the kind of the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in all_spans(text)[1]):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, personal data in the text replaced; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            new = pa.array([None if (s := t.as_py()) is None else redacted(s) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 :]], batch.schema.names)

    return map_in_arrow(docs, run, docs.schema)


def op8_deobfuscated_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
