"""Column functions over text, with the white space and line rules of document processing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a character class that Java and RE2 read alike.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Characters behind which a text may be cut.
STOPS = "。.！!？?；;\n"
# Marks of contents lines.
TOC_MARKS = ("toc", "hyperlink", "pager ef", "\\o", "\\h", "\\u", "_toc", "_ref", "_tab")
# Fixed value: a line of a table of contents with its leaders and page number.
DOT_LEADER = r"^[^\n]{1,150}[.。…]{3,} *\d+[.。… \t]*\z"
# A heading has a title that isn't white space only.
HEADING = rf"^[ \t]*(#{{1,6}})[ \t][^\n]*[^{WS[1:-1]}]"


def utrim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading with a title, else 0."""
    return F.when(line.rlike(HEADING), F.length(F.regexp_extract(line, r"^[ \t]*(#{1,6})[ \t]", 1))).otherwise(0)


def heading_title(line: Column) -> Column:
    """The title of a heading. Marks inside it go, but not where a tab follows the heading's marks."""
    rest = F.regexp_replace(line, r"^[ \t]*#{1,6}", "")
    return utrim(F.when(rest.startswith(" "), F.regexp_replace(rest, r"[#\r\n]", "")).otherwise(rest))


def heading_number(line: Column) -> Column:
    """The dotted number that a line begins with, '' if none: what follows it is nothing, an ASCII blank or, after a number
    with dots, a character that isn't ASCII."""
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)", 1)
    rest = F.substring(line, F.length(number) + 1, F.lit(1))
    ok = rest.rlike(r"^(?:\z|[ \t\n\r])") | (F.contains(number, F.lit(".")) & rest.rlike(r"^[^\x00-\x7F]"))
    return F.when(ok, number).otherwise("")


def after_number(line: Column) -> Column:
    """What follows a heading's number."""
    number = heading_number(line)
    return F.when(number == "", line).otherwise(utrim(F.substring(line, F.length(number) + 1, F.length(line))))


def one_line(c: Column) -> Column:
    """Without white space at the ends, and with one space for each run of it."""
    return F.regexp_replace(utrim(c), f"{WS}+", " ")


def is_dot_leader(trimmed: Column) -> Column:
    """Is a trimmed line one of a table of contents, by its leaders, or its title?"""
    return trimmed.isin("目录", "目 录") | trimmed.rlike(DOT_LEADER)


def clean_leaders(c: Column) -> Column:
    """Without blanks between leaders and around the page number, and without leaders behind it. Blanks between leaders take
    two passes, as a match ends with the leader that the next one begins with."""
    for _ in range(2):
        c = F.regexp_replace(c, r"[.。…][\t\n\f\r ]+[.。…]", "..")
    c = F.regexp_replace(c, r"[.。…][\t\n\f\r ]+(\d)", ".$1")
    c = F.regexp_replace(c, r"(\d)[\t\n\f\r ]+[.。…]", "$1.")
    return F.regexp_replace(c, r"(\d)[.。…]+[\t\n\f\r ]*\z", "$1")


def ends_with_hyphen(c: Column) -> Column:
    return F.right(c, F.lit(1)).isin("-", "\u2010", "\u2011", "\u2012", "\u2013")


def plain_title(c: Column) -> Column:
    """A title without blanks and line breaks."""
    return F.translate(c, " \n\r\t", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def is_toc_content(line: Column) -> Column:
    low = F.lower(utrim(line))
    hit = low.isin("目录", "table of contents")
    for mark in TOC_MARKS:
        hit = hit | F.contains(low, F.lit(mark))
    return hit


def clean_special(c: Column) -> Column:
    """Runs of line breaks and spaces become one, marks and tabs go."""
    c = F.when(c.startswith("|"), c).otherwise(F.regexp_replace(c, r"\n+", "\n"))
    return utrim(F.replace(F.replace(F.regexp_replace(c, " +", " "), F.lit("#"), F.lit("")), F.lit("\t"), F.lit("")))


def sentence_split(text: Column, limit: int) -> Column:
    """The pieces of a text of at most ``limit`` code points, each cut behind the last stop of its window, else hard: one
    pass of a pattern that takes the rest if it fits, else up to a stop, else the window."""
    window = f".{{1,{limit}}}"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){window}\z|{window}(?<=[{STOPS}])|{window}"), F.lit(0))
    return F.filter(F.transform(pieces, utrim), lambda p: p != "")


def re2_to_java(pattern: str) -> str:
    """A pattern of the RE2 dialect as Java reads it: the end is the very end, a dot spares line feeds only, white space has
    no vertical tab."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            two = pattern[k : k + 2]
            out.append({"\\s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]", "\\S": two if inside else r"[^\t\n\f\r ]"}.get(two, two))
            k += 2
            continue
        if inside:
            inside = c != "]" or pattern[k - 1] == "[" or pattern[k - 2 : k] == "[^"
            # Java would read these as a class in a class
            out.append("\\[" if c == "[" and not pattern.startswith("[:", k) else c)
        elif c == "[":
            inside = True
            out.append(c)
        else:
            # a brace that begins no number of repeats stands for itself
            repeats = c != "{" or re.match(r"\{\d+(,\d*)?\}", pattern[k:])
            out.append({"$": r"\z", ".": r"[^\n]"}.get(c, c) if repeats else r"\{")
        k += 1
    return "".join(out)
