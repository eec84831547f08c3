"""Text scalar functions (C1-C4, C6, B1) as JVM-side Column expressions.

Every function maps Columns to a Column, so Catalyst keeps them inside
whole-stage code generation next to the scan; nothing here leaves the JVM
except the optional exact NFKD fold, which is an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# URI pattern removed from every stripped line:  https?[:;]?/?/?\S*
# A line is kept when its normalised length is greater than 1 character.
# Tokens: runs of two or more word characters whose first character is a
# letter; "word character" = Unicode letter, Unicode number or underscore.
# Default minimum document length (characters of the normalised body): 50.
# ---------------------------------------------------------------------------
URI_PATTERN = r"(?U)https?[:;]?/?/?\S*"
MIN_LINE_LENGTH = 2
DEFAULT_MIN_DOC_LENGTH = 50

# Line boundaries of Python's universal-newline line reader.
LINE_BREAK_PATTERN = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# White space stripped from both ends of a line: Unicode white space and the
# information separators, which Python also takes as space.
EDGE_SPACE = "".join(chr(cp) for cp in range(0x10000) if chr(cp).isspace())


def token_pattern(min_term_length: int = 2) -> str:
    """Java regex for one token: a letter at a word start, then word chars."""
    rest = max(min_term_length, 2) - 1
    return "(?<![\\p{L}\\p{N}_])\\p{L}[\\p{L}\\p{N}_]{%d,}" % rest


# ---------------------------------------------------------------------------
# Accent folding. The tables are built by rule from NFKD forms without their
# combining marks: characters that become one other character, combining marks
# (deleted), and characters that become several ASCII letters (ligatures).
# ---------------------------------------------------------------------------
@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    marks = [chr(cp) for cp in range(0x80, 0x10000) if unicodedata.combining(chr(cp))]
    return "".join(src + marks), "".join(dst)  # translate deletes what has no counterpart


@lru_cache(maxsize=1)
def ligature_table() -> dict[str, str]:
    out = {}
    for cp in range(0x80, 0x10000):
        base = unicodedata.normalize("NFKD", chr(cp))
        if len(base) > 1 and base.isascii() and base.isalpha():
            out[chr(cp)] = base.lower()
    return out


def strip_accents_exact(s: str | None) -> str | None:
    if s is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _nfkd_fold(s: pd.Series) -> pd.Series:
    return s.map(strip_accents_exact)


def fold_accents(col: Column, exact: bool = False) -> Column:
    """Lowercase, then drop accents.

    Default: one ``translate`` with the rule-built table (JVM, codegen), which
    also deletes combining marks; an ASCII text needs none, and only a text with
    characters beyond the narrow range of accented Latin letters is looked
    through for ligatures. ``exact=True``: full NFKD semantics for the rest of
    the one-to-many forms too (Hangul syllables), through an Arrow-batched UDF.
    """
    low = F.lower(col)
    if exact:
        return _nfkd_fold(low)
    src, dst = fold_table()
    folded = F.translate(low, src, dst)
    # One small expression however many ligatures there are: a chain of calls would make the generated method too long
    # for the JVM to compile.
    pairs = F.array(*[F.array(F.lit(char), F.lit(letters)) for char, letters in ligature_table().items()])
    spelled = F.aggregate(pairs, folded, lambda text, pair: F.replace(text, pair[0], pair[1]))
    return (F.when(F.octet_length(low) == F.char_length(low), low)
            .when(~low.rlike(f"[{min(ligature_table())}-\uffff]"), folded)
            .when(low.rlike("[" + "".join(ligature_table()) + "]"), spelled).otherwise(folded))


def strip_uris(col: Column) -> Column:
    """C1 on one line: strip, then delete every URI-like run."""
    return F.regexp_replace(F.btrim(col, F.lit(EDGE_SPACE)), URI_PATTERN, "")


def body_lines(col: Column) -> Column:
    """Normalised lines of a text: split, strip, URIs removed, short lines dropped."""
    lines = F.split(F.coalesce(col, F.lit("")), LINE_BREAK_PATTERN)
    cleaned = F.transform(lines, strip_uris)
    return F.filter(cleaned, lambda line: F.length(line) >= MIN_LINE_LENGTH)


def normalize_body(col: Column) -> Column:
    """C1 + C2: the body the reference builds from a file, '\\n' after each kept line. The lines are named once: in a
    condition and its branch they would be worked out twice."""
    return F.array_join(F.transform(body_lines(col), lambda line: F.concat(line, F.lit("\n"))), "")


def tokenize(col: Column, min_term_length: int = 2, exact_fold: bool = False) -> Column:
    """C3 + C4: array of tokens of the folded text, in text order."""
    return F.regexp_extract_all(fold_accents(col, exact_fold), F.lit(token_pattern(min_term_length)), 0)


def remove_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """C5 on a token array (order kept). ``isin`` becomes a hash-set test."""
    if not stopwords:
        return tokens
    words = sorted(set(stopwords))
    return F.filter(tokens, lambda t: ~t.isin(words))


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 1) -> Column:
    """Word n-grams joined by a space; unigrams first, then 2-grams, ...

    The n-grams of length n zip n shifted slices of the token array, so no
    lambda refers back to the (expensive) token expression.
    """
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(tokens)
            continue
        length = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        shifted = [F.slice(tokens, i, F.greatest(length, F.lit(1))).alias(str(i)) for i in range(1, n + 1)]
        grams = F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *[z[str(i)] for i in range(1, n + 1)]))
        parts.append(F.when(length >= 1, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def doc_identity(path: Column) -> tuple[Column, Column]:
    """B1: (label, doc_id) from a file path.

    label = name of the parent folder with spaces as '_'; id = base name
    without its last extension, prefixed by ``label_`` unless it already
    starts with the label.
    """
    parent = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    label = F.replace(parent, F.lit(" "), F.lit("_"))
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    # os.path.splitext: leading dots belong to the name, the last '.ext' goes.
    lead = F.regexp_extract(base, r"^(\.*)", 1)
    rest = F.substring(base, F.length(lead) + 1, 1 << 30)
    stem = F.when(
        F.instr(rest, ".") > 0, F.concat(lead, F.regexp_replace(rest, r"\.[^.]*$", ""))
    ).otherwise(base)
    doc_id = F.when(F.startswith(stem, label), stem).otherwise(F.concat(label, F.lit("_"), stem))
    return label, doc_id
