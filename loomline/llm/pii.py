"""Personal data, found through disguises, with spans in the source text.

Detectors for e-mail addresses, IPv4 addresses, card numbers and phone numbers run on the text as it is (the base spans) and on
normalised text. Normalising is done by transducers, each of which rewrites some stretches and keeps an edit list, so that any
position of its output maps back to its input:

- homoglyphs: look-alike letters, full-width and other digits and signs become ASCII; invisible characters go;
- spelled digits: runs of three or more English digit words, with `plus` before them, become digits;
- at and dot: `name [at] host (dot) org`, `name at host dot org`, `10 dot 0 dot 0 dot 1`, `10[.]0[.]0[.]1`, `&#64;`, `%40`.

Spans found in normalised text are mapped back through all edit lists and added unless a base span of their kind holds them.
A bare `at` counts only before a host with a disguised dot, or with a name that has a digit, dot or underscore, so that prose
with `at` stays as it is.

Everything is one pass over whole texts where they are read. What a text must hold for a transducer to find something is searched for
first, so that most texts pay for a few plain searches. Each step is linear in a text's length: cores of disguises are found
first, blanks around them are widened over by hand, and names and hosts are walked from them label by label, of any length.

Defined results: null is as an empty text; spans are in code points, end exclusive; equal spans are given once; rows that repeat an
id are read one by one; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_name, small_batches

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
QUAD = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]")  # in every address, and quicker to search for
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @, the run of name characters before it and the host after it; what a regular expression finds, without its
    quadratic time on long runs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            out.append((start, last))
        else:
            last = max(last, at + 1)  # no later match can begin before this @
        at = text.find("@", max(at + 1, last))
    return out


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of everything in a text."""
    out = [(s, e, 0) for s, e in emails(text)]
    for m in IP.finditer(text) if QUAD.search(text) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return out


class Edited:
    """A text after a transducer. An edit is (start in the output, its length, start in the input, its length)."""

    def __init__(self, text: str, rewrites: list[tuple[int, int, str]]):
        parts, at, size = [], 0, 0
        self.edits: list[tuple[int, int, int, int]] = []
        for start, end, new in rewrites:
            parts += [text[at:start], new]
            size += start - at
            self.edits.append((size, len(new), start, end - start))
            size += len(new)
            at = end
        self.text = "".join([*parts, text[at:]])
        self.starts = [e[0] for e in self.edits]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The input's span of an output's span that isn't empty."""
        return self._char(start)[0], self._char(end - 1)[1]

    def _char(self, at: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.starts, at) - 1
        if i < 0:
            return at, at + 1
        new, size, old, was = self.edits[i]
        if at < new + size:
            return (old + at - new, old + at - new + 1) if size == was else (old, old + was)
        return old + was + at - new - size, old + was + at - new - size + 1


# Letters of other scripts and the ASCII letters they look like, and characters that are not seen.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα",
        "ABEKMHOPCTYXSIJaeopcyxsijhdqwgABEZHIKMNOPTYXova",
        strict=True,
    )
)
INVISIBLE = "­᠎​‌‍⁠﻿"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

FOLDED = re.compile(
    "[" + "".join(LOOKALIKES) + INVISIBLE + "٠-٩۰-۹०-९০-৯‐-―․⁰-⁹₀-₉"
    "①-⑨⒈-⒐﹒﹫！-～\U0001d400-\U0001d7ff]+"
)
_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
SPELLED = re.compile(rf"\b(?:plus[\s-]+)?{_DIGIT}(?:[\s,-]+{_DIGIT}){{2,}}\b", re.IGNORECASE)
SPELLED_PART = re.compile(rf"(plus|{_DIGIT})(?:[\s,-]+|$)", re.IGNORECASE)
_HIDDEN_DOT = r"(?:[ \t]*[(\[{<][ \t]*(?:dot|\.)[ \t]*[)\]}>][ \t]*|[ \t]+dot[ \t]+|&#46;|%2e)"
_DOT = rf"(?:\.|{_HIDDEN_DOT})"
HIDDEN_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
MAY_HIDE_IP = re.compile(rf"[0-9]{_HIDDEN_DOT}[0-9]", re.IGNORECASE)
IP_DOT = re.compile(_HIDDEN_DOT, re.IGNORECASE)
#: Cores of disguises; those in the group `spaced` take the blanks around them, which are widened over by hand.
DOT_CORE = re.compile(r"(?P<spaced>[(\[{<][ \t]*(?:dot|\.)[ \t]*[)\]}>]|(?<=[ \t])dot(?=[ \t]))|&#46;|%2e", re.IGNORECASE)
AT_CORE = re.compile(r"(?P<spaced>[(\[{<][ \t]*(?:at|@)[ \t]*[)\]}>]|(?<=[ \t])(?:at|@)(?=[ \t]))|@|&#64;|&commat;|%40", re.IGNORECASE)
PERCENT_DOT = re.compile("%2e", re.IGNORECASE)
LABEL = re.compile(r"[A-Za-z0-9-]+")
NAME_CHARS = LOCAL_CHARS - {"."}
TELLING = re.compile("[0-9._]")


def fold(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "‐" <= c <= "―":
        return "-"
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) > 1 and plain[0].isdigit():
        return plain[0]
    if len(plain) == 1 and plain > "\x7f" and plain.isdecimal():
        return str(unicodedata.decimal(plain))
    return plain if len(plain) == 1 and plain < "\x7f" else c


#: What a text must hold, in lower case, for a transducer to find something in it; cheap to search for.
THREE_DIGITS = re.compile(rf"{_DIGIT}[\s,-]+{_DIGIT}[\s,-]+{_DIGIT}")
CASELESS = "\u0130\u0131\u017f"  # equal to i or s where case is ignored, but not once in lower case
PLAIN = str.maketrans(CASELESS, "iis")
BRACKET_DOT = re.compile(r"[(\[{<][ \t]*\.")
BRACKET_AT = re.compile(r"[(\[{<][ \t]*(?:at|@)")
AT_HOST = re.compile(r"at[ \t]+[a-z0-9-]+\.[a-z0-9-]")


def may_spell(text: str) -> bool:
    return any(c in text for c in CASELESS) or THREE_DIGITS.search(text.lower()) is not None


def may_hide_dot(low: str) -> bool:
    return "dot" in low or "&#46;" in low or "%2e" in low or BRACKET_DOT.search(low) is not None


def may_hide_at(low: str) -> bool:
    """Beside a text without hidden dots: an `@` in disguise, or `at` before a host."""
    if "@" in low and any(c in low for c in (" @", "\t@", "@ ", "@\t")):
        return True
    return "&#64;" in low or "&commat;" in low or "%40" in low or BRACKET_AT.search(low) is not None or AT_HOST.search(low) is not None


class _Folds(dict):
    def __missing__(self, c: str) -> str:
        self[c] = found = fold(c)
        return found


_folds = _Folds()  # of the characters FOLDED names, some thousands


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    return [(i, i + 1, new) for m in FOLDED.finditer(text) for i, c in enumerate(m[0], m.start()) if (new := _folds[c]) != c]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in SPELLED.finditer(text) if may_spell(text) else ():
        parts = list(SPELLED_PART.finditer(text, m.start(), m.end()))
        for p in parts:
            word = p[1].translate(PLAIN).lower()
            out.append((p.start(), p.end() if p is not parts[-1] else p.end(1), "+" if word == "plus" else str(DIGIT_WORDS.index(word))))
    return out


def disguises(core: re.Pattern, text: str) -> list[tuple[int, int, str]]:
    """(start, end, core) of each disguise, by start. A run of blanks is widened over from its two sides at most."""
    out = []
    for m in core.finditer(text):
        start, end = m.span()
        if m.lastgroup:
            while start and text[start - 1] in " \t":
                start -= 1
            while end < len(text) and text[end] in " \t":
                end += 1
        out.append((start, end, m[0]))
    return out


def host_after(text: str, at: int, dots: dict[int, int]) -> tuple[int, list[tuple[int, int]]] | None:
    """(end, hidden dots used) of the host that begins at `at`; `dots` are hidden dots, start to end."""
    label, end, labels, used = LABEL.match(text, at), at, 0, []
    while label:
        end, labels = label.end(), labels + 1
        after = end + 1 if text.startswith(".", end) else dots.get(end)
        if after is None:
            break
        label = LABEL.match(text, after)
        if label and text[end] != ".":
            used.append((end, after))
    return (end, used) if labels > 1 else None


def name_before(text: str, end: int, floor: int, dots: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """(start, hidden dots used) of the name that ends at `end`, by walking back to `floor` at most; `dots`: end to start."""
    start, used, at, dot = end, [], end, None
    while True:
        run = at
        while run > floor and text[run - 1] in NAME_CHARS:
            run -= 1
        if run == at:
            break
        if dot:
            used.append(dot)
        start = run
        at, dot = (run - 1, None) if run > floor and text[run - 1] == "." else (dots.get(run, -1), (dots.get(run, -1), run))
        if at < floor:
            break
    return start, used[::-1]


def at_and_dot(text: str) -> list[tuple[int, int, str]]:
    out, last = [], 0
    low = text.lower()
    dotted = may_hide_dot(low)
    if not dotted and not may_hide_at(low):
        return out
    hidden = disguises(DOT_CORE, text) if dotted else []
    ahead, behind = {s: e for s, e, _ in hidden}, {e: s for s, e, _ in hidden}
    for start, end, core in disguises(AT_CORE, text):
        host = host_after(text, end, ahead) if start >= last else None
        if not host:
            continue
        name, in_name = name_before(text, start, last, behind)
        if name == start:
            continue
        in_name = sorted(in_name + [m.span() for m in PERCENT_DOT.finditer(text, name, start)])
        if not in_name and not host[1]:
            if core == "@" and end - start == 1:
                continue
            if core.lower() == "at" and not TELLING.search(text, name, start):
                continue
        out += [(s, e, ".") for s, e in in_name]
        out.append((start, end, "@"))
        out += [(s, e, ".") for s, e in host[1]]
        last = host[0]
    if dotted and MAY_HIDE_IP.search(text):
        starts, more = [s for s, _, _ in out], []
        for m in HIDDEN_IP.finditer(text):
            i = bisect.bisect_left(starts, m.end()) - 1
            if i < 0 or out[i][1] <= m.start():
                more += [(d.start(), d.end(), ".") for d in IP_DOT.finditer(text, m.start(), m.end())]
        out = sorted(out + more)
    return out


TRANSDUCERS = (homoglyphs, spelled_digits, at_and_dot)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, end, index of the kind), in order of start, then kind."""
    text = text or ""
    base = sorted(detect(text), key=lambda s: (s[0], s[2], s[1]))
    chain, now = [], text
    for transducer in TRANSDUCERS:
        if rewrites := transducer(now):
            chain.append(Edited(now, rewrites))
            now = chain[-1].text
    if not chain:
        return base, base
    by_kind: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for s, e, k in base:
        by_kind[k].append((s, e))
    added = set()
    for s, e, k in detect(now):
        for step in reversed(chain):
            s, e = step.span(s, e)
        i = bisect.bisect_right(by_kind[k], (s, len(text) + 1)) - 1
        if i < 0 or by_kind[k][i][1] < e:
            added.add((s, e, k))
    return base, sorted({*base, *added}, key=lambda s: (s[0], s[2], s[1]))


def redact(text: str | None) -> str | None:
    """`text` with each stretch of spans that touch replaced by the name of its first kind; null stays null."""
    _, spans = find(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: (doc_id, base, spans), both arrays of (kind, start, end)."""

    def run(frames):
        for frame in frames:
            found = [find(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    **{
                        name: [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in row[i]] for row in found]
                        for i, name in enumerate(("base", "spans"))
                    },
                }
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind: string, start: long, end: long>>"
    found = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(
        run, f"doc_id string, base {span}, spans {span}"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))  # as strings, ids are exact beside nulls


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with personal data replaced, and `length_col`, where there is one, set anew on the rows that changed."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    small_batches(docs.sparkSession)
    clean = free_name(docs, "__text")
    made = docs.withColumn(clean, cleaned(F.col(f"`{text_col}`")))
    changed = ~F.col(clean).eqNullSafe(F.col(f"`{text_col}`"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(clean).alias(c))
        elif c == length_col:
            new = F.char_length(clean).cast(docs.schema[c].dataType)
            columns.append(F.when(changed, new).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return made.select(*columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query. The counts are of base spans; n_added counts what the transducers add to `spans`."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
