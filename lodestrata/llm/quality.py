"""Per-document text statistics, and natural prose told from lists, tables and junk.

Counts of words, lines and symbols are joined by statistics of repetition: the share of lines and of
paragraphs that occurred before, and the share of the characters that the most frequent word
3-gram covers. Every line that can be seen is read as one of

* prose - a run of at least three plain words (or of letters of a script without spaces),
* row - cells of a table: the same number of separators as most lines, a grid, or markup cells,
* junk - encoded bytes, bars, rules, unreadable symbols, letters without vowels, one short line
  over and over,
* entry - a marked or short line of an enumeration, or the parts of a line that enumerates inline,

and the combined rules weigh these by their characters: prose that is at least half of the text
makes the document prose; otherwise the largest of the others names the kind. Repetition enters
them three times: a text that one 3-gram dominates is junk; where most lines were said before, a repeated
line without a run of words is junk; where most paragraphs were, boilerplate is weighed once.
Sentences that are said again stay sentences.

Defined results: a null, empty or blank text has zero counts and no kind; a single short line that
is none of these is prose; texts are read whole; ties go to prose, then table, list, junk.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The commonest words of the languages that are expected.
COMMON_WORDS = frozenset(
    """the of and to in a is that it for was on are as with be this by at from or not which but we have an they you can will has one all
    der die das und ist nicht mit den von zu im auf für ein eine des dem auch sich wird nach bei war noch
    le la les de des du et est un une dans pour pas que qui sur au avec plus par ce il nous
    el los las y en una del se por con no para al lo es su más
    и в не на что с по из к за это для от но как до ещё был
    o os da do em um uma não com il di che per non sono het een van niet""".split()
)

MARKER = re.compile(r"^\s*(?:[-*+•‣◦▪–—·]\s+|\[[ xX✓]?\]\s+|\(?\d{1,4}[.)]\s+|#\d+\s+|\(?[A-Za-z][.)]\s+)")
PLAIN = r"[\"'“”„«»(\[¿¡‘’*_]*[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*[\"'“”«»)\]’*_]*"
RUN = regex.compile(rf"(?<![^\s]){PLAIN},?(?:[  ]{PLAIN},?){{2,}}[.,;:!?…»\"]*(?![^\s])")
ASCII_PLAIN = r"[\"'(\[*_]*[A-Za-z]+(?:'[A-Za-z]+)*[\"')\]*_]*"
ASCII_RUN = re.compile(rf"(?<![^\s]){ASCII_PLAIN},?(?: {ASCII_PLAIN},?){{2,}}[.,;:!?\"]*(?![^\s])")
RUN_ONE = regex.compile(rf"(?<![^\s]){PLAIN}[.,;:!?…]*(?![^\s])")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{4,}")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-_.][\p{L}\p{M}\p{N}]+)*")
INVISIBLE = regex.compile(r"[\p{Cf}]")
LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
HEX_DUMP = re.compile(r"^\s*(?:[0-9a-fA-F]{6,8}:?\s+)?(?:[0-9a-fA-F]{2,4}\s+){6,}[0-9a-fA-F]{2,4}\b")
ENCODED = re.compile(r"^\s*[A-Za-z0-9+/=_\-]{40,}\s*$")
RULED = regex.compile(r"^[^\p{L}\p{N}]*$")
GRID = re.compile(r"^\s*[|+]?[\s:]*[-=]{2,}[-=\s:|+]*$")
BAR = re.compile(r"([#=█▓▒░.▌▏>\-])\1{7,}")
CELL = re.compile(r"</?t[drh]\b|</?table\b", re.I)
LONE_SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\-–—…«»“”‘’„¿¡。、「」・/@#_&%+*=<>\[\]{}|\\`~^$§°]|[\p{Co}\p{Cn}\p{Cc}&&[^\t]]", regex.V1)
UNREADABLE = regex.compile(r"[[\p{Cc}\p{Co}\p{Cn}]--[\t\n\r\x0b\x0c\x85]]|\ufffd", regex.V1)
ASCII_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\s]")
CODE = re.compile(r"[(){}\[\];=|&^<>+*!?:$]")
OTHER = regex.compile(r"[^\p{Latin}\p{Cyrillic}\p{Greek}]+")
NO_LETTER = {i: None for i in range(128) if not chr(i).isalpha()}
VOWELS = "aeiouyæœøаеёиоуыэюяіїєαεηιουω"
ENDINGS = tuple(".!?…。！？:;»”\"'")

PARAGRAPH_END = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
#: A text of which one 3-gram covers this share of the characters says nothing.
DOMINANT = 0.9
#: From this share of repeated paragraphs on, a repeated line is weighed once.
BOILERPLATE = 0.5

FIELDS = [
    ("n_words", LongType()), ("n_lines", LongType()), ("n_paragraphs", LongType()), ("mean_word_length", DoubleType()), ("symbol_ratio", DoubleType()),
    ("punctuated_line_share", DoubleType()), ("common_word_share", DoubleType()), ("duplicate_line_share", DoubleType()),
    ("duplicate_paragraph_share", DoubleType()), ("top_ngram_share", DoubleType()), ("prose_share", DoubleType()), ("kind", StringType()),
]
SCHEMA = StructType([StructField("doc_id", LongType()), *[StructField(n, t) for n, t in FIELDS]])


def _share(part: float, whole: float) -> float:
    return round(part / whole, 6) if whole else 0.0


def _repeated(items: list[str]) -> float:
    return _share(len(items) - len(set(items)), len(items))


def _vowelless(text: str) -> bool:
    """Letters with too few vowels for any language that writes them."""
    if text.isascii():
        plain, vowels = text.lower().translate(NO_LETTER), "aeiouy"
    else:
        plain, vowels = OTHER.sub("", unicodedata.normalize("NFKD", text.casefold())), VOWELS
    return len(plain) >= 24 and sum(map(plain.count, vowels)) < 0.29 * len(plain)


def _separators(lines: list[str]) -> str | None:
    """The separator that divides most lines into the same number of cells."""
    for mark in ("\t", "|", ";", ","):
        counts = Counter(x.count(mark) for x in lines)
        often, n = max(counts.items(), key=lambda kv: (kv[1], kv[0]))
        cells = sum(counts[k] * (k + 1) for k in counts)
        if often and len(lines) > 1 and n >= 0.7 * len(lines) and sum(len(x.split()) for x in lines) <= 2.5 * cells:
            return mark
    gaps = sum(len(re.findall(r"\S {2,}(?=\S)", x)) > 0 for x in lines)
    return "  " if len(lines) > 2 and gaps >= 0.7 * len(lines) else None


def _said(line: str) -> int:
    """Characters in runs of plain words; a marked line must consist mostly of them."""
    body = MARKER.sub("", line, count=1)
    size = sum(len(m.group()) for m in (ASCII_RUN if body.isascii() else RUN).finditer(body))
    if not size and not body.isascii() and UNSPACED.search(body):
        size = len(body.strip())
    return size if size >= 0.6 * len(body.strip()) or not MARKER.match(line) else 0


@dataclass(frozen=True)
class Repetition:
    """How much of a text was said before: shares of lines and of paragraphs, characters under the most frequent 3-gram."""

    lines: float
    paragraphs: float
    top_ngram: float


def repetition(text: str, lines: list[str], words: list[str]) -> Repetition:
    paragraphs = [x.strip() for x in PARAGRAPH_END.split(text) if x.strip()]
    return Repetition(_repeated(lines), _repeated(paragraphs), top_ngram(words))


def top_ngram(words: list[str]) -> float:
    """The share of the characters that the most frequent 3-gram of words covers; 0 if none comes twice."""
    grams: Counter = Counter(zip(words, words[1:], words[2:]))
    top, times = max(grams.items(), key=lambda kv: (kv[1], kv[0])) if grams else ((), 0)
    letters = sum(map(len, words))
    return _share(min(letters, times * sum(map(len, top))) if times > 1 else 0, letters)


def _line_kinds(lines: list[str]) -> Counter:
    """Characters of the lines by what they are."""
    kinds: Counter = Counter()
    cells = [x for x in lines if not RULED.match(x) and not MARKER.match(x)]
    mark = _separators(cells) if cells else None
    grids = sum(bool(GRID.match(x)) for x in lines)
    times = Counter(x.strip() for x in lines)
    said_before = _share(len(lines) - len(times), len(lines))
    said = [_said(x) for x in lines]
    for i, line in enumerate(lines):
        size = len(line.strip())
        symbols = 0 if line.isascii() and line.isprintable() else len(LONE_SYMBOL.findall(line))
        body = MARKER.sub("", line, count=1)
        if CELL.search(line):
            kinds["table"] += size
        elif symbols > 0.15 * size:
            kinds["junk"] += size
        elif RULED.match(line):
            kinds["table" if grids and GRID.match(line) and mark == "|" else "junk"] += size
        elif HEX_DUMP.match(line) or ENCODED.match(line) or BAR.search(line):
            kinds["junk"] += size
        elif said[i]:
            kinds["junk" if _vowelless(body) else "prose" if said[i] >= 0.2 * size or not mark else "table"] += size
        elif said_before >= 0.8 and times[line.strip()] >= 8:
            kinds["junk"] += size
        elif mark and not MARKER.match(line) and mark in line:
            kinds["table"] += size
        elif size > 80 and " " not in line.strip() and len(CODE.findall(line)) > 0.15 * size:
            kinds["junk"] += size
        elif size > 60 and len(CODE.findall(line)) > 0.25 * size:
            kinds["junk"] += size
        elif _vowelless(line) and not re.search(r"[\d@./_]", line):
            kinds["junk"] += size
        elif not MARKER.match(line) and (said[i - 1] if i else 0) + (said[i + 1] if i + 1 < len(said) else 0) and RUN_ONE.search(line):
            kinds["prose"] += size  # the rest of a wrapped sentence
        else:
            kinds["list"] += size
    return kinds


def _inline(line: str) -> bool:
    """One line that enumerates: at least four short parts between the same separators."""
    for mark in (r"\s*;\s*", r"\s+/\s+", r"\s*\|\s*", r"\s*,\s*", r"\s+[·•]\s+"):
        parts = [p for p in re.split(mark, line) if p]
        if len(parts) >= 4 and sum(len(p.split()) <= 3 for p in parts) >= 0.9 * len(parts):
            return True
    return False


def kind_of(text: str) -> tuple[str | None, float]:
    """(list, table, junk or prose; the share of prose), nothing of a text that can't be seen."""
    shown = INVISIBLE.sub("", text)
    lines = [x for x in LINE_END.split(shown) if x.strip()]
    if not lines:
        return None, 0.0
    unreadable = ASCII_CONTROL if shown.isascii() else UNREADABLE
    if len(unreadable.findall(shown)) > 0.04 * len(shown):
        return "junk", 0.0
    tokens = shown.replace("...", " ").split()
    distinct = len(set(tokens))
    if len(tokens) >= 10 and 2 * distinct <= len(tokens) and (distinct <= min(3, 0.1 * len(tokens)) or top_ngram(tokens) >= DOMINANT):
        return "junk", 0.0  # a few words over and over
    stripped = [x.strip() for x in lines]
    if len(set(stripped)) < len(lines):
        said = repetition(shown, stripped, [])
        if said.paragraphs >= BOILERPLATE:
            lines = list(dict.fromkeys(lines))  # boilerplate counts once
    kinds = _line_kinds(lines)
    if len(lines) > 1 and not re.search(r"[|\t;,]", lines[0]) and len(lines[0]) < 40:
        # a heading does not change the kind of what follows
        rest = _line_kinds(lines[1:])
        if rest.total():
            kinds, lines = rest, lines[1:]
    if kinds["table"] and len(lines) == 1:
        kinds["list"] += kinds.pop("table")
    total = kinds.total()
    prose = kinds["prose"] / total
    if prose >= 0.5:
        return "prose", prose
    best = max(("table", "list", "junk"), key=lambda k: kinds[k])
    if best == "list":
        marked = sum(bool(MARKER.match(x)) for x in lines)
        if len(lines) < 3 and marked < len(lines) and not any(map(_inline, lines)):
            return "prose", prose
    return best, prose


def profile(text: str | None) -> tuple:
    """The statistics of one text, in the order of FIELDS."""
    text = text or ""
    lines = [x.strip() for x in LINE_END.split(text) if x.strip()]
    n_paragraphs = sum(bool(x.strip()) for x in PARAGRAPH_END.split(text))
    words = WORD.findall(text)
    letters = sum(map(len, words))
    shown = sum(map(len, text.split()))
    said = repetition(text, lines, words)
    kind, prose = kind_of(text)
    return (
        len(words), len(lines), n_paragraphs, round(letters / len(words), 6) if words else 0.0,
        _share(len(SYMBOL.findall(text)), shown),
        _share(sum(x.endswith(ENDINGS) for x in lines), len(lines)),
        _share(sum(w.casefold() in COMMON_WORDS for w in words), len(words)),
        said.lines, said.paragraphs, said.top_ngram,
        round(prose, 6), kind,
    )


def _profiles(batches):
    for batch in batches:
        rows = [(i, *profile(t)) for i, t in zip(batch["doc_id"], batch["text"])]
        yield pd.DataFrame(rows, columns=SCHEMA.names)


def _kinds(batches):
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "kind": [kind_of(t or "")[0] for t in batch["text"]]})


def text_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics, kind) of every document; one pass, no shuffle."""
    return docs.select("doc_id", "text").mapInPandas(_profiles, SCHEMA)


def text_kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, kind) of every document: of the statistics only what the rules read."""
    return docs.select("doc_id", "text").mapInPandas(_kinds, "doc_id long, kind string")
