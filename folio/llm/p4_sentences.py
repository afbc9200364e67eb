"""Problem 4: sentence boundaries across languages and scripts, in SQL expressions only.

Full stops that end nothing (in decimals, web addresses, initials and abbreviations, and terminators inside quotations)
are masked with private-use characters of the same length, so that positions stay what they were; quotations may be of any
length. Boundaries are then
found by terminators of the scripts: full stop, exclamation and question marks where no small letter follows, the
Greek question mark, ideographic terminators, danda and Arabic question mark, spaces in Thai, and blank lines. Each
boundary gets a mark, the text is split at the marks, and the sentences are taken from the unmasked text by position.

Defined results: null, empty and blank texts give no sentence; a text without terminators is one sentence; positions
are code points from 0, ends exclusive; rows delivered twice count once; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import table

MASK, CUT, EDGE = "", "", ""
# Abbreviations after which no sentence ends, by language.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "St", "Prof", "Fig", "cf", "vs", "approx", "pp", "Co", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec",
    "Nr", "bzw", "ca", "inkl", "vgl", "Abb", "Hr", "Fr", "Str",
    "Sr", "Sra", "Srta", "Dra", "Ing", "pág", "págs", "aprox", "núm", "Lic",
    "Mme", "Mlle", "art", "av", "env", "Me",
    "ул", "см", "рис", "стр", "им", "гл", "тыс",
    "डॉ", "κα", "Δρ",
)
# Abbreviations that only stand before a number.
NUMBERED = ("No", "no", "Nos", "n", "num", "vol", "ch")
_LETTER = r"\p{L}\p{M}"
#: Characters that are not seen, and closing marks.
_NONE = r"\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}"
_CLOSE = r"[\"”’»)\]]"
#: What is masked, one after another. Each pattern begins with the terminator and looks back from there, so that the
#: rest of the text costs one comparison a character.
_WORD = rf"(?<![{_LETTER}\p{{N}}.])"
MASKS = (
    r"\.(?<=\p{N}\.)(?=\p{N})",
    r"\.(?<=[\p{L}\p{N}/\-]\.)(?=[\p{Ll}\p{N}])",
    rf"\.(?<={_WORD}(?:{'|'.join(ABBREVIATIONS)})\.)",
    rf"\.(?<={_WORD}(?:{'|'.join(NUMBERED)})\.)(?=\s*\p{{N}})",
    # initials; not the s of a genitive, nor the last letter of p.m.
    rf"\.(?<=(?<![{_LETTER}\p{{N}}.’'{MASK}])\p{{L}}\.)(?=\s)",
    # a German ordinal
    r"\.(?<=(?<!\p{L})(?:[Ii]m|[Aa]m|[Dd]er|[Dd]em|[Dd]en|[Dd]as|[Dd]ie|[Vv]om|[Zz]um|[Bb]eim) \p{N}{1,2}\.)(?=\s+\p{Lu})",
)
#: Quotations: opening mark, closing mark, what stands between, the terminators masked inside, may they stand behind a line
#: break, and what spares the last one (in corner brackets nothing does).
QUOTED = (
    ("“", "”", "[^“”]", "[.!?…。！？؟]", False, "(?!”$)"),
    ("„", "“", "[^„“]", "[.!?…]", False, "(?!“$)"),
    ("«", "»", "[^«»]", "[.!?…؟]", False, "(?!»$)"),
    ("「", "」", "[^「」]", "[。！？]", False, ""),
    (r"(?<![^\s(.!?])\"(?=[\p{L}¿¡])", "\"", "[^\"]", "[.!?…]", True, "(?!\"$)"),
)
#: Ends of sentences, one after another; a mark is put behind what matches.
BOUNDARIES = (
    r"\n[^\S\n]*\n",
    # alphabets: a terminator, closing marks, then white space and anything but a small letter, a dash or a comma
    rf"[.!?．…؟।॥]{_CLOSE}{{0,3}}[{_NONE}]{{0,2}}(?=\s+[{_NONE}]{{0,3}}[^\s{_NONE}\p{{Ll}}—–,;:\-.…”»)])",
    rf"[.!?…]“(?=\s+[{_NONE}]{{0,3}}[^\s{_NONE}\p{{Ll}}—–,;:\-])",
    # the space between two sentences was lost
    rf"[.!?](?<=(?:\p{{Ll}}{{2}}|[’']\p{{Ll}}|\p{{N}}{{2}}).){_CLOSE}{{0,2}}(?=\p{{Lu}}[\p{{L}}’' ]|[¡¿]|“\p{{Lu}}|«\s?\p{{Lu}}|\"\p{{Lu}}|\(\p{{Lu}})",
    # the Greek question mark
    r"[;;](?<=[\p{IsGreek}]»?.)»?(?=\s+[^\s\p{Ll}])",
    # ideographic terminators
    r"(?:[。！？｡]++[”」』）]*+)++",
    # Thai: a space ends a sentence
    r"[฀-๿][?!”\"]{0,3}(?=\s+[฀-๿“])",
)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""

    def one(x: Column) -> Column:
        return f(x)

    return F.get(F.transform(F.array(value), one), F.lit(0))


def _one_kind(text: Column, start: str, end: str, inside: str, marks: str, over_lines: bool, last: str) -> Column:
    whole = f"(?U){start}{inside}*+{end}"

    def joined(parts: Column) -> Column:
        def quiet(p: Column, k: Column) -> Column:
            head = p if over_lines else F.substring_index(p, "\n", 1)
            out = F.regexp_replace(head, F.lit(f"(?U){marks}{last}"), F.lit(MASK))
            if not over_lines:
                out = F.concat(out, F.substring(p, F.length(head) + 1, F.length(p)))
            if end == "”":
                goes_on = F.get(parts, k - 1).rlike(r"(?U)(?:^|[^：:\s])\s{0,2}$")
                out = F.when(goes_on, F.regexp_replace(out, "[。！？](?=”$)", MASK)).otherwise(out)
            return F.when(k % 2 == 1, out).otherwise(p)

        return F.array_join(F.transform(parts, quiet), "")

    return F.when(text.rlike(whole), _bound(F.split(F.regexp_replace(text, F.lit(whole), F.lit(f"{EDGE}$0{EDGE}")), EDGE), joined)).otherwise(text)


def quotations_masked(text: Column) -> Column:
    """Terminators inside quotations masked, but for the last one. The text is cut at the quotations, each found whole by one
    pattern, so that their length doesn't matter. The last terminator goes too where the sentence goes on behind a Chinese
    quotation; after a colon the quotation ends the sentence."""
    for kind in QUOTED:
        text = _bound(text, lambda t, kind=kind: _one_kind(t, *kind))
    return text


def masked(text: Column) -> Column:
    for pattern in MASKS:
        text = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(MASK))
    return quotations_masked(text)


def sentences(text: Column) -> Column:
    """array<struct<start_at, end_at>> of a text column."""
    marked = masked(F.translate(text, CUT + EDGE, "??"))
    for pattern in BOUNDARIES:
        marked = F.regexp_replace(marked, F.lit("(?U)" + pattern), F.lit("$0" + CUT))
    pieces = F.split(marked, CUT)
    # places: where each piece begins and its trimmed part
    trimmed = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.length(F.regexp_replace(p, r"(?U)^\s+", "")).alias("l"), F.length(F.regexp_replace(p, r"(?U)^\s+|\s+$", "")).alias("t")))
    zero = F.struct(F.expr("cast(array() as array<struct<start_at: int, end_at: int>>)").alias("done"), F.lit(0).alias("at"))

    def add(a: Column, p: Column) -> Column:
        start = a["at"] + p["n"] - p["l"]
        more = F.when(p["t"] > 0, F.concat(a["done"], F.array(F.struct(start.alias("start_at"), (start + p["t"]).alias("end_at"))))).otherwise(a["done"])
        return F.struct(more.alias("done"), (a["at"] + p["n"]).alias("at"))

    return F.aggregate(trimmed, zero, add, lambda a: a["done"])


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_at, end_at, sentence), in a row each."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), F.explode(sentences(F.col(text))).alias("s"))
    return rows.select(key, "s.start_at", "s.end_at", F.expr("substring(_t, s.start_at + 1, s.end_at - s.start_at)").alias("sentence"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    sample = table(spark, folder, "sentence_sample").select("chunk_id").distinct()
    # the sample grows with the data: Spark broadcasts it only while its size is below the threshold
    chunks = table(spark, folder, "chunks").select("chunk_id", "content").join(sample, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    return sentence_rows(chunks, "chunk_id", "content").select("chunk_id", "start_at", "end_at")


def p4_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every chunk."""
    return sentence_rows(table(spark, folder, "chunks").select("chunk_id", "content").dropDuplicates(["chunk_id"]), "chunk_id", "content")


QUERIES = {"p4_found": p4_found, "p4_sentences": p4_sentences}
ORACLE: dict[str, str] = {}
