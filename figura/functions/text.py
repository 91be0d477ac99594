"""Column expressions for text: whitespace, tokenisers, spans.

All but ``affix_tokens`` are built-in Spark expressions, so they run inside
whole-stage codegen next to the scan and need no Python at run time.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
#
# Whitespace: exactly the characters Python's str.split()/str.strip() treat
# as whitespace: tab, line feed, vertical tab, form feed, carriage return,
# U+001C..U+001F, space, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028,
# U+2029, U+202F, U+205F, U+3000.
# WS_CLASS_SQL spells the set out (for RE2 engines); WS_CLASS is the same
# set for Java regex: Java's whitespace predicate plus the four characters
# it leaves out (U+0085, U+00A0, U+2007, U+202F), about 2.5x faster.
WS_CLASS_SQL = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_CLASS = r"[\p{javaWhitespace}\x{85}\x{A0}\x{2007}\x{202F}]"
# INFIX_CHARS: characters the punctuation-infix tokenizer splits on:
# . , ? : ; ‘ ’ ` “ ” " ' ~
INFIX_CLASS = "[.,?:;‘’`“”\"'~]"
# WORD_CLASS: characters of a word for the word normaliser: letters,
# letter-like and other numerics (not decimal digits), and underscore.
WORD_CLASS = r"[\p{L}\p{Nl}\p{No}_]"
# Word normaliser length bounds (inclusive).
WORD_MIN_LEN = 2
WORD_MAX_LEN = 15
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def normalize_whitespace(c) -> Column:
    """``' '.join(x.split())``: collapse whitespace runs to one space, trim
    (after the collapse only plain spaces can remain at the ends)."""
    return F.trim(F.regexp_replace(_c(c), f"{WS_CLASS}+", " "))


def whitespace_tokens(c) -> Column:
    """``x.split()``: tokens between whitespace runs; ``''`` gives ``[]``
    (the only empty pieces a split can leave are at the ends)."""
    return F.array_remove(F.split(_c(c), f"{WS_CLASS}+"), "")


def join_tokens(c, sep: str = " ") -> Column:
    """``' '.join(tokens)``."""
    return F.array_join(_c(c), sep)


def word_tokens(c) -> Column:
    """Word normaliser: lower-case, runs of word characters, keep tokens of
    2..15 characters that do not start with an underscore."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit(f"({WORD_CLASS}+)"), 1)
    return F.filter(
        runs,
        lambda w: (F.length(w) >= WORD_MIN_LEN) & (F.length(w) <= WORD_MAX_LEN)
        & ~w.startswith("_"))


def first_word(c) -> Column:
    """``word_tokens(c)[0]`` or ``''``, without tokenising the whole text:
    the first maximal word run of 2..15 characters not starting with an
    underscore (lookarounds make the run maximal), found by one
    ``regexp_extract`` that stops at the first match."""
    w = WORD_CLASS
    pat = f"(?<!{w})(?!_)({w}{{{WORD_MIN_LEN},{WORD_MAX_LEN}}})(?!{w})"
    return F.regexp_extract(F.lower(_c(c)), pat, 1)


def infix_tokens(c) -> Column:
    """Punctuation-infix tokenizer: every infix character becomes its own
    token, the rest splits on whitespace."""
    spaced = F.regexp_replace(_c(c), f"({INFIX_CLASS})", " $1 ")
    return whitespace_tokens(spaced)


# Marks that the affix tokenizer takes off the beginning and the end of a
# chunk, and chunks that stay whole: defaults of the rule set, an argument.
PREFIXES = "([{<\"'`“‘«$€£§#"
SUFFIXES = ")]}>\"'`”’».,!?;:%…"
EXCEPTIONS = ("e.g.", "i.e.", "etc.", "Mr.", "Mrs.", "Dr.", "U.S.", "p.m.", "a.m.", "...", "'s", "'t", ":)", ":(")


def affix_tokens(c, prefixes: str = PREFIXES, suffixes: str = SUFFIXES, exceptions=EXCEPTIONS, infix: str = INFIX_CLASS) -> Column:
    """Tokens of a rule set: each chunk between white space loses a mark of
    ``prefixes`` from its beginning and one of ``suffixes`` from its end, again
    and again, every mark a token of its own, until neither is there or what
    is left is one of ``exceptions``. What is left is split at ``infix``
    characters (tokens too) unless it is an exception.

    Marks are taken off one character after another, which Spark's own
    expressions fold over every character of every chunk; here Python cuts
    each different chunk of an Arrow batch once."""
    none = frozenset(exceptions)
    at_infix = re.compile(f"({infix})")

    def cut(x: str) -> list[str]:
        pre, suf = [], []
        while x and x not in none:
            front = x[0] in prefixes
            if front:
                pre.append(x[0])
                x = x[1:]
            back = x != "" and not (front and x in none) and x[-1] in suffixes
            if back:
                suf.append(x[-1])
                x = x[:-1]
            if not (front or back):
                break
        inner = [x] if x in none else [y for y in at_infix.split(x) if y]
        return [*pre, *inner, *reversed(suf)]

    def run(texts: pa.Array) -> pa.Array:
        number: dict[str, int] = {}                      # tokens in order of their codes
        codes: dict[str, list[int]] = {}                 # of each chunk met
        flat, ends = array("i"), [0]
        for t in texts:
            for x in (t.as_py() or "").split():
                got = codes.get(x)
                if got is None:
                    got = codes[x] = [number.setdefault(y, len(number)) for y in cut(x)]
                flat.extend(got)
            ends.append(len(flat))
        words = pa.DictionaryArray.from_arrays(pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()), pa.array(list(number), pa.string()))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.cast(pa.string()), mask=texts.is_null())
    return F.arrow_udf(run, "array<string>")(_c(c))


def char_span(context, sentence) -> Column:
    """0-based ``[start, end)`` of the first occurrence of ``sentence`` in
    ``context`` (``str.find``); start is -1 when it does not occur."""
    ctx, sent = _c(context), _c(sentence)
    start = F.position(sent, ctx) - 1
    return F.struct(start.alias("start"), (start + F.length(sent)).alias("end"))


def utf8_roundtrip(c) -> Column:
    """Encode to UTF-8 bytes and decode back (a no-op on valid text)."""
    return F.decode(F.encode(_c(c), "UTF-8"), "UTF-8")
