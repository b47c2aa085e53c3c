"""Text measures, keywords, content types, log templates and prompt compression."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words and negations of the keyword and contradiction rules.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
    "from", "is", "it", "its", "this", "that", "be", "as", "are", "was", "were", "has", "have",
    "had", "not", "no", "so", "if", "do", "did", "he", "she", "we", "you", "they", "i", "me", "my",
    "your", "our", "their", "his", "her", "up", "out", "will", "can", "may", "all",
]
NEGATIONS = [
    "not ", "never ", "no ", "don't ", "doesn't ", "didn't ", "won't ", "can't ", "cannot ",
    "isn't ", "aren't ", "wasn't ", "weren't ",
]
CATEGORIES = ["fact", "instruction", "conversation", "code", "preference"]

#: White space, or ASCII punctuation but apostrophe and hyphen.
SEPARATOR = r"[\s!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]+"
MIN_CHARS = 200


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sentence_count(text: Column) -> Column:
    """Marks that end sentences; 1 at least, 0 for an empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]")))).cast("long")


_BLANKS = str.maketrans(dict.fromkeys("!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~", " "))  # SEPARATOR, but for white space
_STOPPED = frozenset(STOP_WORDS)


def keyword_list(text: str | None, k: int = 10) -> list[str] | None:
    """The ``k`` most frequent lower-case tokens of three bytes or more that are not stop words, ties by word."""
    if text is None:
        return None
    counts: Counter[str] = Counter()
    for raw, n in Counter(text.translate(_BLANKS).split()).items():
        w = raw.lower()
        if not w.isalnum():
            keep = [i for i, c in enumerate(w) if c.isalnum()]
            w = w[keep[0] : keep[-1] + 1] if keep else ""
        if len(w.encode()) >= 3 and w not in _STOPPED:
            counts[w] += n
    return sorted(counts, key=lambda w: (-counts[w], w))[:k]


def keywords(text: Column, k: int = 10) -> Column:
    """Keywords of each text, in Arrow batches: linear in the text, where array functions would be quadratic."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: keyword_list(t, k))

    return run(text)


def language_hint(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    ascii_ = F.regexp_count(text, F.lit(r"[A-Za-z]"))
    return F.when(letters == 0, "latin").when(ascii_ * 2 >= letters, "latin").otherwise("other")


def normal_category(category: Column) -> Column:
    c = F.lower(F.trim(category))
    return F.when(c.isin(CATEGORIES), c).otherwise("general")


def is_negated(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.exists(F.array(*map(F.lit, NEGATIONS)), lambda p: t.startswith(p))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# ---------------------------------------------------------------------------- content types

# The signs of log lines, declarations, errors and stack frames by which kinds of texts are told apart.
LEVELS = ["ERROR", "WARN", "INFO", "DEBUG", "TRACE"]
_BRACKETED = r"^\[(ERROR|WARN|INFO|DEBUG|TRACE)\]|^\[\d{4}-\d{2}-\d{2}"
_LOG_LINE = r" (INFO|WARN|ERROR|DEBUG|TRACE) |\[(info|warn|error)\]|^(ERROR|WARN|INFO|DEBUG|TRACE)[ :\t]|^\[(ERROR|WARN|INFO|DEBUG|TRACE)\]"
_STAMPED = r"^.{4}-..-..[T ]..:.{5,}"
_SHORT_CODE = r"^(fn |pub fn |def |function |class |impl |struct |enum )"
_WORDS = r"fn|pub fn|pub\(crate\) fn|def|function|async fn|class|impl|struct|enum|trait|const|let|use|import|from"

# Tests of whole texts, line by line: a line begins after spaces, only a line feed (after a carriage return or not) ends it.
_BRACED = r"[{}][^\n]*"
_INDENTED = r"(?md)^(?:    |\t)"
_CLOSED = r"; *(?:\r?\n|\z)"
_KEYWORD = rf"(?md)^ *(?:(?:{_WORDS}) +(?:[^ \r\n]|\r(?!\n))|#\[)"
_ERROR = r"(?md)^ *(?:Error:|error:|error\[)"
_EXCEPTION = r"(?md)^ *Exception:"
_FRAME = r"(?md)^ *at [^\n]*(?:\(|::)"
HEAD = 10


def _n_lines(text: Column) -> Column:
    """Lines of a text; a last line end makes no line."""
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1))


def _head(text: Column) -> Column:
    """The first lines without their ends."""
    first = F.substring_index(text, "\n", HEAD)
    first = F.when(F.length(first) < F.length(text), F.regexp_replace(first, r"\r\z", "")).otherwise(F.regexp_replace(text, r"\r?\n\z", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(first, r"\r?\n"))


def content_type(text: Column) -> Column:
    """json, log, code, error or prose. Lines are counted by patterns over the whole text; only its head is split."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    left, head, lines = F.ltrim(F.regexp_replace(text, r"^\s+", "")), _head(text), _n_lines(text)
    n_log = F.size(F.filter(head, lambda l: F.trim(l).rlike(_LOG_LINE) | F.trim(l).rlike(_STAMPED)))
    is_json = (left.startswith("{") | left.startswith("[")) & ~left.rlike(_BRACKETED)
    is_log = (F.size(head) >= 3) & (n_log >= 2)
    structure = (count(_BRACED) + count(_INDENTED) + count(_CLOSED)) / (F.lit(3.0) * lines)
    is_code = F.when(lines <= 2, F.trim(text).rlike(_SHORT_CODE)).otherwise((structure > 0.15) & (count(_KEYWORD) / lines > 0.05))
    signs = [
        text.contains("panicked at"), text.contains("Traceback"), text.contains("stack trace"), text.contains("thread '") & text.contains("panicked"),
        text.rlike(_ERROR), text.rlike(_EXCEPTION), count(_FRAME) >= 2, text.contains("Caused by:"),
    ]
    n_signs = sum((F.when(s, 1).otherwise(0) for s in signs[1:]), F.when(signs[0], 1).otherwise(0))
    return F.when(is_json, "json").when(is_log, "log").when(is_code, "code").when(n_signs >= 2, "error").otherwise("prose")


# ---------------------------------------------------------------------------- log templates

#: One alternation, values of keys first, then the most specific; each match is replaced by the name of what it is.
MASKS = [
    ("KV", r"(?<==)(?:\"[^\"]*\"?|[^ \t\",][^ \t,]*)"),
    ("TS", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d(?::?\d\d)?)?"),
    ("UUID", r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![A-Za-z0-9_-])"),
    ("IP", r"(?<![A-Za-z0-9_.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.\d)(?::\d{1,5})?(?![A-Za-z0-9_])"),
    ("DUR", r"(?<![A-Za-z0-9_.])\d+(?:\.\d+)?(?:ns|us|ms|kb|mb|gb|KB|MB|GB|s|m|h|B)(?![A-Za-z0-9_])"),
    ("HEX", r"(?<![A-Za-z0-9_])(?:0[xX][0-9A-Fa-f]+|(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{4,})(?![A-Za-z0-9_])"),
    ("INT", r"(?<![A-Za-z0-9_.])\d+(?![A-Za-z0-9_.])"),
]
_MASK = re.compile("|".join(f"(?P<{n}>{p})" for n, p in MASKS), re.A)


def mask_line(line: str) -> str:
    """A log line with its variable fields masked."""
    return _MASK.sub(lambda m: f"<{m.lastgroup}>", line)


def log_template(line: Column) -> Column:
    """Templates of log lines, in Arrow batches."""

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else mask_line(x))

    return run(line)


def split_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def compress_log(text: str) -> str:
    """Runs of lines with one template become their first line and a count."""
    out, run = [], []

    def flush() -> None:
        first, template = run[0][0], run[0][1]
        more = f"  [x{len(run)}{'' if template == first else f' ~ {template}'}]" if len(run) > 1 else ""
        out.append(first + more)

    for line in split_lines(text):
        t = mask_line(line)
        if run and run[0][1] != t:
            flush()
            run = []
        run.append((line, t))
    if run:
        flush()
    return "\n".join(out).rstrip()


def collapse_text(text: str) -> str:
    return " ".join(text.split())


_SENTENCE = re.compile(r"[^.!?…\n]*[.!?…]+[\"')\]]*(?=\s|$)\s*|[^\n]+?(?=\n|$)\n?", re.S)


def sentences(text: str) -> list[str]:
    """Sentences by closing marks and line ends (an approximation of the Unicode rules)."""
    return [s for s in (m.strip() for m in _SENTENCE.findall(text)) if s]


def compress_prose(text: str) -> str:
    s = sentences(text)
    if len(s) <= 6:
        return collapse_text(text)
    return " ".join([*s[:3], f"[… {len(s) - 6} sentences elided …]", *s[-3:]]).rstrip()


# The signs of languages, in the order in which they are tried (any group of which all strings occur), and
# what a line looks like that declares something in each.
_LANGUAGES = [
    ("rust", [("fn ", "let "), ("fn ", "impl ")]),
    ("python", [("def ", ":")]),
    ("javascript", [("function ",), ("const ",), ("let ",)]),
    ("java", [("public class ",), ("void ",)]),
    ("cpp", [("#include",), ("std::",)]),
    ("go", [("package main",), ("func ",)]),
    ("sql", [("SELECT ",), ("FROM ",)]),
]
_SIGNATURES = {
    "rust": re.compile(r"^(pub (async )?fn |(async )?fn |pub struct |pub enum |struct |enum |trait |pub trait |impl ).*(?<!,)$"),
    "python": re.compile(r"^((async )?def |class )"),
    "javascript": re.compile(r"^((async )?function |class )|=> \{|^const .*function"),
    "java": re.compile(r"^(?!//|\*)(?=.*\()(?=.*\)).*[{;]$"),
}
_SIGNATURES["cpp"] = _SIGNATURES["java"]


def language(text: str) -> str:
    return next((name for name, signs in _LANGUAGES if any(all(s in text for s in group) for group in signs)), "unknown")


def signatures(text: str, lang: str) -> list[str]:
    lines = (x.strip() for x in split_lines(text))
    lines = [x for x in lines if x and not x.startswith(("//", "#"))]
    if lang in _SIGNATURES:
        return [x for x in lines if _SIGNATURES[lang].search(x)]
    return [x for x in lines if "(" in x and ")" in x and len(x.encode()) < 200]


def compress_code(text: str) -> str:
    lang = language(text)
    kept = signatures(text, lang)
    if not kept:
        return collapse_text(text)
    return "\n".join([f"// [headroom: {lang} body elided — {len(kept)} signature(s) kept]", *kept])


_COMPRESS = {"log": compress_log, "code": compress_code, "prose": compress_prose, "error": compress_prose}


def compress_one(text: str | None, kind: str) -> str | None:
    """The compressed text if that is shorter and not blank, else the text; short texts stay."""
    if text is None or len(text.encode()) < MIN_CHARS:
        return text
    out = _COMPRESS.get(kind, collapse_text)(text)
    return out if out.strip() and len(out.encode()) < len(text.encode()) else text


def compress(text: Column, kind: Column | None = None) -> Column:
    """Compresses each text by its content type (found by column expressions if not given)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([compress_one(t, k) for t, k in zip(texts, kinds)])

    return run(text, content_type(text) if kind is None else kind)


def count_tokens(text: Column, tokenizer=None) -> Column:
    """Tokens by a callable; without one an approximation by words and marks (no public table of the
    reference vocabulary is at hand offline)."""
    if tokenizer is None:
        return F.regexp_count(text, F.lit(r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]")).cast("long")

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else len(tokenizer(t)))

    return run(text)
