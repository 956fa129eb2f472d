"""Personal data in whole texts, also behind homoglyphs, spelled digits and at/dot disguises.

The text is searched as it is and once more after a chain of small transducers has undone the
disguises. The transducers keep, for every character they write, the source span it stands for; a
span found in the undone text is reported at the source characters that produced it. Offsets are
code points, ends exclusive. A null text is empty. Each text is one row of work; patterns are
written so that long runs of letters or digits cost linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a run of digits that fails from its start fails from inside
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, int]  # place in KINDS, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:  # no part of an address before the sign holds another sign
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = AFTER_AT.match(text, at) if start < at else None
        if match:
            found.append((0, start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    if text.count(".") >= 3:
        for match in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
                found.append((1, *match.span()))
    for match in CARD.finditer(text):
        if 13 <= match.end() - match.start() <= 40:
            digits = NOT_DIGIT.sub("", match[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *match.span()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", match[0])) <= 15:
                found.append((3, *match.span()))
    return found


# Characters that look like an ASCII one, and the ASCII characters in the same order.
LOOK_ALIKE = "АВЕЅІЈКМНОРСТХУаеоѕіјрсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧον٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९․。‐‑‒–—−﹫\u00a0\u2007\u202f"
LOOKS_LIKE = "ABESIJKMHOPCTXYaeosijpcyxdhqwABEZHIKMNOPTYXov012345678901234567890123456789..------@   "
PLAIN = {ord(a): b for a, b in zip(LOOK_ALIKE, LOOKS_LIKE, strict=True)} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
STRANGE = re.compile("[" + re.escape("".join(map(chr, PLAIN))) + "]")
# Digits as words.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
DIGIT = "(?:" + "|".join(DIGITS) + ")"
# Endings of host names that make words around a plain "at" and "dot" an address.
ENDINGS = "com|org|net|edu|gov|info|biz|io|co|eu|uk|us|de|fr|es|it|nl|ch|at|be|pt|pl|ca|au|jp|cn|in|br|mx|ru"
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"  # written, but not seen
# One pass finds every disguise; what it stands for is written by `_undo`.
DISGUISE = re.compile(
    rf"(?P<hidden>[{HIDDEN}]+)"
    rf"|(?P<digits>(?<![^\W_])(?:plus[\x20-]+)?{DIGIT}(?:[\x20,.-]+{DIGIT})+(?![^\W_]))"
    r"|(?P<at>[\x20]?(?:\(at\)|\[at\]|\{at\}|<at>)[\x20]?)"
    r"|(?P<dot>[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)[\x20]?)"
    rf"|(?P<spelled>(?<=[A-Za-z0-9])[\x20]at[\x20](?=[A-Za-z0-9-]+(?:[\x20]dot[\x20][A-Za-z0-9-]+)*[\x20]dot[\x20](?:{ENDINGS})(?![A-Za-z0-9-]))"
    r"|(?<=[A-Za-z0-9-])[\x20]dot[\x20](?=[A-Za-z0-9]))",
    re.IGNORECASE,
)
HINT = re.compile(rf"[{HIDDEN}]|[(\[{{<](?:at|dot)[)\]}}>]|\x20dot\x20|{DIGIT}[\x20,.-]+{DIGIT}", re.IGNORECASE)
DIGIT_OR_PLUS = re.compile(rf"plus|{DIGIT}", re.IGNORECASE)


def _undo(text: str) -> tuple[str, list[int], list[tuple[int, int, bool]]] | None:
    """The text without disguises and its pieces, or None if there is nothing to undo.

    Piece i begins at `starts[i]` of the new text and stands for the source span `(from, to)`; a
    copied piece maps character by character, any other as a whole.
    """
    plain = text if text.isascii() or not STRANGE.search(text) else text.translate(PLAIN)
    if not HINT.search(plain):
        return None if plain is text else (plain, [0], [(0, len(text), True)])
    out: list[str] = []
    starts: list[int] = []
    pieces: list[tuple[int, int, bool]] = []
    size = done = 0

    def put(piece: str, a: int, b: int, copied: bool) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            starts.append(size)
            pieces.append((a, b, copied))
            size += len(piece)

    for match in DISGUISE.finditer(plain):
        a, b = match.span()
        put(plain[done:a], done, a, True)
        if match.lastgroup == "digits":
            for word in DIGIT_OR_PLUS.finditer(plain, a, b):
                put(DIGITS.get(word[0].lower(), "+"), word.start(), word.end(), False)
        elif match.lastgroup == "at" or match.lastgroup == "spelled" and match[0].strip().lower() == "at":
            put("@", a, b, False)
        elif match.lastgroup != "hidden":
            put(".", a, b, False)
        done = b
    put(plain[done:], done, len(plain), True)
    return "".join(out), starts, pieces


def hidden_spans(text: str, base: list[Span], longer: bool = True) -> list[Span]:
    """Spans seen only without the disguises, at their source characters.

    None lies inside a base span of its kind. One that reaches beyond a base span is the same identifier,
    seen whole: wanted where all of it must go from the text, but not where identifiers are counted (`longer` false).
    """
    undone = _undo(text)
    if undone is None:
        return []
    plain, starts, pieces = undone
    found = []
    for kind, start, end in base_spans(plain):
        i, j = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        (a, _, copied), (c, d, copied_end) = pieces[i], pieces[j]
        span = (kind, a + start - starts[i] if copied else a, c + end - starts[j] if copied_end else d)
        met = [(s, e) for k, s, e in base if k == kind and s < span[2] and span[1] < e]
        if not met or longer and not any(s <= span[1] and span[2] <= e for s, e in met):
            found.append(span)
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`(id, base, hidden)`: arrays of (kind, start, end) of each row, by kind as listed, then start.

    An identifier disguised in part counts once, by its base span.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, hidden = [], []
            for value in batch.column(1):
                value = value.as_py() or ""
                plain = base_spans(value)
                base.append(named(plain))
                hidden.append(named(sorted(hidden_spans(value, plain, longer=False))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, arrow), pa.array(hidden, arrow)], names=["id", "base", "hidden"])

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, base {span}, hidden {span}")


def redact_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    base = base_spans(text)
    spans = sorted((a, b, k) for k, a, b in base + hidden_spans(text, base))
    out, done, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[done:a], f"<{KINDS[kind]}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data taken out of the text; null texts stay null, other columns as they are."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.schema.field(place)
            clean = pa.array([None if t.as_py() is None else redact_text(t.as_py()) for t in batch.column(place)], field.type)
            yield batch.set_column(place, field, clean)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
