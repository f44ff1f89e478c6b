"""Wiki and HTML markup removal as a list of staged expressions."""

from __future__ import annotations


import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import trim
from .vector import let

# Letters that a broken code page left, and what they stand for.
CODEPAGE_FROM, CODEPAGE_TO = "ęşŕăčľîđ", "êºàãèçíð"

# Marks of a line that is still markup, and characters that no line starts with.
MARKERS = [
    "align=", "width=", "style=", "colspan=", "rowspan=", "latM=", "lonM=", "latS=", "lonS=", "latG=", "lonG=", "class=", "bgcolor=", "valign=", "border=",
    "{{Infobox", "{{Caixa", "{{Info/", "{{Taxobox", "{{Se-", "{{Ref", "{{Ver ", "{{Main", "!--", "-->", "{|", "|-", "|}", "||",
]
MARKUP_CHARS, BAD_START = "{}[]|<>=", "{}[]|<>=*#!:;"
MIN_BYTES, MAX_MARKUP, MIN_ALPHA, MIN_WORDS, ROUNDS = 30, 3, 0.7, 5, 5


@dataclass(frozen=True)
class Step:
    """One replacement: pattern for the JVM, pattern for RE2, replacement."""

    name: str
    pattern: str
    to: str = ""
    re2: str | None = None

    @property
    def sql_pattern(self) -> str:
        return self.re2 or self.pattern


# The patterns, in order.
COMMENT = Step("c1", r"<!--[\s\S]*?-->")
REF = Step("c2", r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>")
TABLE = Step("c3", r"(?s)\{\|.*?\|\}", " ")
ROW = Step("c4", r"\|-[^\n]*\n?", " ")
TEMPLATE = Step("c5a", r"\{\{[^{}]*+\}\}", "", r"\{\{[^{}]*\}\}")
NESTED = Step("c5b", r"\{\{(?:[^{}]++|\{\{[^{}]*+\}\})*+\}\}", "", r"\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\}")
BEFORE = [COMMENT, REF, TABLE, ROW]
AFTER = [
    Step("c6", r"\[\[(?:Categoria|Category):[^\]]+\]\]"),
    Step("c7", r"\[\[(?:Ficheiro|Imagem|File|Image):[^\]]+\]\]"),
    Step("c8", r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
    Step("c9", r"\[\[([^\]]+)\]\]", "$1"),
    Step("c10", r"(?U)\[https?://[^\s\]]+\s+([^\]]+)\]", "$1", r"\[https?://[^\s\]]+\s+([^\]]+)\]"),
    Step("c11", r"\[https?://[^\]]+\]"),
    Step("c12", r"<[^>]+>"),
    Step("c13", r"&[a-zA-Z]+;|&#[0-9]+;", " "),
    Step("c14", r"(?iU)(align|width|height|style|class|colspan|rowspan|bgcolor|valign|border|cellpadding|cellspacing|scope|lang)\s*=\s*\"?[^\"|}\n]*\"?", "",
         r"(?i)(align|width|height|style|class|colspan|rowspan|bgcolor|valign|border|cellpadding|cellspacing|scope|lang)\s*=\s*\"?[^\"|}\n]*\"?"),
    Step("c15", r"(?iU)(lat|lon|latitude|longitude)[MDSG]?\s*=\s*[\d.\-]+", "", r"(?i)(lat|lon|latitude|longitude)[MDSG]?\s*=\s*[\d.\-]+"),
    Step("c16", r"'{2,5}"),
    Step("c17", r"(?U)\A={1,6}\s*([^=]+?)\s*={1,6}\s*\z", "$1\n", r"\A={1,6}\s*([^=]+?)\s*={1,6}\s*\z"),
]
LIST_ITEM = Step("c18", r"(?U)^[*#:;]+\s*", "", r"^[*#:;]+\s*")
LATE = [
    Step("c19", r"\|+", " "),
    Step("c20", r"(?U)([a-zA-ZÀ-ÿ])(\d{4})([^\d]|\z)", "$1 $2$3", r"([a-zA-ZÀ-ÿ])(\d{4})([^\d]|\z)"),
    Step("c21", r"(?U)([a-zà-ú])-\s+([a-zà-ú])", "$1$2", r"([a-zà-ú])-\s+([a-zà-ú])"),
    Step("c22", r"[ \t]+", " "),
    Step("c23", r"\n{3,}", "\n\n"),
]

_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def apply(text: Column, step: Step) -> Column:
    return F.regexp_replace(text, step.pattern, step.to)


def fix_codepage(text: Column) -> Column:
    return F.translate(text, CODEPAGE_FROM, CODEPAGE_TO)


def unescape_or_keep(text: str) -> str:
    """XML entities of the whole text, or the text as it is if one of them is not valid."""
    out, at = [], 0
    while (start := text.find("&", at)) >= 0:
        end = text.find(";", start)
        if end < 0:
            return text
        name = text[start + 1 : end]
        if name in _NAMED:
            value = _NAMED[name]
        elif re.fullmatch(r"#[0-9]+|#x[0-9a-fA-F]+", name):
            code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
            if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000:
                return text
            value = chr(code)
        else:
            return text
        out += [text[at:start], value]
        at = end + 1
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unescape_or_keep(t))


def unescape(text: Column) -> Column:
    """Texts without `&` skip Python."""
    return F.when(F.contains(text, F.lit("&")), _unescape(text)).otherwise(text)


def templates(text: Column, rounds: int = ROUNDS) -> Column:
    """Innermost ones first; texts without an opening mark are done at once."""

    def rounds_of(t: Column) -> Column:
        out = t
        for _ in range(rounds):
            out = apply(apply(out, TEMPLATE), NESTED)
        return F.when(F.contains(t, F.lit("{{")), out).otherwise(t)

    return let(text, rounds_of)


def list_items(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, LIST_ITEM.pattern, ""))
    return F.array_join(lines, "\n")


def valid_line(line: Column) -> Column:
    """Cheapest tests first; `line` may carry blanks around it."""
    return _valid(trim(line))


def _valid(t: Column) -> Column:
    letters, visible = F.regexp_count(t, F.lit(r"\p{IsAlphabetic}")), F.regexp_count(t, F.lit(r"[^\p{IsWhite_Space}]"))
    quoted = "|".join(re.escape(m).replace("\\-", "-").replace("\\ ", " ") for m in MARKERS)
    return (
        (F.octet_length(t) >= MIN_BYTES)
        & ~t.rlike(quoted)
        & (F.regexp_count(t, F.lit(r"[{}\[\]|<>=]")) <= MAX_MARKUP)
        & (letters.cast("double") / F.greatest(visible, F.lit(1)) >= MIN_ALPHA)
        & (F.size(F.split(t, r"(?U)\s+")) >= MIN_WORDS)
        & ~t.rlike(r"^[{}\[\]|<>=*#!:;]")
    )


def filter_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), trim), _valid), "\n")


def clean_markup(text: Column, rounds: int = ROUNDS) -> Column:
    """All replacements, without the entity step before and the line filter after."""
    for s in BEFORE:
        text = apply(text, s)
    text = templates(text, rounds)
    for s in AFTER:
        text = apply(text, s)
    text = list_items(text)
    for s in LATE:
        text = apply(text, s)
    return text


def clean(text: Column, entities: bool = True) -> Column:
    text = fix_codepage(text)
    return trim(filter_lines(clean_markup(unescape(text) if entities else text)))


def html_text(text: Column) -> Column:
    for s in (COMMENT, *[a for a in AFTER if a.name in ("c12", "c13", "c14")]):
        text = apply(text, s)
    return text


__all__ = ["apply", "clean", "clean_markup", "filter_lines", "fix_codepage", "html_text", "list_items", "templates", "unescape", "valid_line"]
