"""Problem 1: per-document text quality statistics, and what they say about a document.

Statistics of each text, all JVM expressions: words, mean word length, share of symbols, share of lines ending in
punctuation, share of common words of the language, ends of sentences per letter, vocabulary richness, share of words without vowels, the longest word, and the share of
characters on lines of lists, tables, menus and contents. Each statistic gets a mergeable KLL quantile sketch per
language (script, and for Latin script the language whose common words are most frequent). A value becomes a robust z:
its distance from the median in units of the spread of that half of the distribution that junk doesn't reach, or of a
floor where the statistic hardly varies. Texts are flagged whose structure share lies in the upper tail, or of whose
word statistics several lie in their junk tails. Fillers have few letters or none: a text without words is flagged, and
one of mostly other characters if its symbols or its longest word lie in the tail.

Statistics of words aren't judged (null) where the text is damaged by a wrong encoding or has fewer than LETTERS letters;
symbols and the longest word are judged with few letters too. The number of words and the share of line ends get their
sketch and z like the others but have no part in the verdict, as prose may be short or cut off.

Defined results: null, empty and blank texts have null statistics and are no case; rows delivered twice count once;
languages with few texts use what their own sketch gives, with the floors; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.p2_forms import LOOKS
from folio.session import table

# Common words by language.
COMMON = {
    "en": "the an of and in that it is was were to with for by not but this has have so had",
    "de": "der die das den dem und ist nicht in mit wir eine ein hier von ob zu für im als",
    "fr": "le la les de et est une un dans que en on pour qui sont ne était où pas",
    "es": "el la los de es un una en que no por se más con del está cerca también",
    "pt": "os de um uma em que não por se mais do da no na está perto foi mas",
    "ru": "и в не на что это она но где он для был была все ещё если когда с",
    "el": "η ο το και είναι την της στην δεν που μία ένα πολύ με εδώ",
    "ar": "في كان كل ما لا هذا من على قال إن عام قرب أين لماذا",
    "hi": "है और को का की के में यह से थे पर एक ने हैं",
}
# Characters and words that sentences of languages without spaces can't do without.
FUNCTION = {"zh": "[了是在和把就也着那这不但所比说]", "ja": "[はをがにでとた]", "th": "(?:ที่|ได้|นี้|ใน|ว่า|ไม่|มา)"}
#: By language: its script. The order is the one in which letters are taken out of a text.
SCRIPTS = {"ru": r"\p{IsCyrillic}", "zh": r"\p{IsHan}", "ja": r"\p{IsHiragana}\p{IsKatakana}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}", "el": r"\p{IsGreek}", "th": r"\p{IsThai}"}
LATIN = ("en", "de", "fr", "es", "pt")
#: statistic: (is junk below the median?, least spread)
TAILS = {"common": (True, 0.06), "richness": (True, 0.05), "ends": (True, 0.25), "word_length": (False, 0.7), "symbols": (False, 0.03), "voiceless": (False, 0.06), "longest": (False, 12.0), "structure": (False, 0.1)}
JUDGED = tuple(s for s in TAILS if s != "structure")
#: The same of statistics that get a sketch and a z but have no part in the verdict.
SHOWN = {"n_words": (True, 8.0), "line_ends": (True, 0.25)}
#: Robust z from which a structure share, and any other statistic, lies in the tail.
STRUCTURE_Z, TAIL_Z = 5.0, 3.0
#: Letters from which statistics of words are judged.
LETTERS = 8
#: Letters, digits and the full stop, which have full-width forms.
PLAIN = [46, *range(48, 58), *range(65, 91), *range(97, 123)]
END = r"[.!?…。！？؟।；;:：][\"”’»)\]）」』]*\s*$"


# Kinds of space, characters that are not seen, and full-width letters, digits and full stop.
SPACES, UNSEEN, WIDE = r"\x{A0}\x{2002}\x{2003}\x{2005}\x{2007}\x{2009}\x{202F}\x{3000}", r"\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}", r"\x{FF0E}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}"


def _plain(text: Column) -> Column:
    """In ordinary widths and spaces, without what is not seen."""
    t = F.regexp_replace(F.regexp_replace(text, f"[{SPACES}]", " "), f"[{UNSEEN}]+", "")
    # a translation looks every character up
    wide = F.translate(t, "".join(chr(k + 0xFEE0) for k in PLAIN), "".join(map(chr, PLAIN)))
    return F.when(text.rlike(f"[{WIDE}]"), wide).otherwise(t)


def _looks(text: Column) -> Column:
    pairs = [(c, like) for like, cs in LOOKS.items() if like.isascii() for c in cs]
    return F.translate(text, "".join(c for c, _ in pairs), "".join(x for _, x in pairs))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _ends(line: Column) -> Column:
    """Does a line end in punctuation? Only its last characters are looked at."""
    return F.substring(line, -6, 6).rlike(END)


def _chars(text: Column, kind: str) -> Column:
    """How many characters of a class a text has: one match for each run of them, not for each."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(kind + "+"), F.lit("")))


def _structured(line: Column, ended: Column) -> Column:
    """Is a line, without white space around it, one of a list, table, menu or contents? Written as a chain of cases, so
    that an ordinary line of prose costs two patterns."""
    # a search for a string is far cheaper than a pattern, and an anchored pattern fails at once
    has = lambda *strings: reduce(lambda a, b: a | b, (F.contains(line, F.lit(x)) for x in strings))
    contents = has("....", ". . . . ", "……") & line.rlike(r"\.{4,}|(?:\. ){4,}|…{2,}\s*\p{N}")
    cells = has("\t") | line.rlike(r"^[│|┃].*[│|┃]\s*$") | (has("  ") & line.rlike(r"\S {2,}\S.*\S {2,}\S"))
    lists = (has(";") & line.rlike(r"^[^;\s]+(?: [^;\s]+)?(?:;[^;\s]+(?: [^;\s]+)?){2,}$")) | (has(",") & line.rlike(r"^[^,\s]{1,24}(?: [^,\s]{1,24})?(?:,[^,\s]{1,20}){2,}(?<![.!?])$"))
    cells = cells | lists
    menu = line.rlike(r"^(?:[^|/»·•›>]{1,40}\s[|/»·•›>]\s){3,}")
    item = line.rlike(r"^(?:[-*•▪‣◦●○■□–—·]|\(?\p{N}{1,3}[.)）、]|\(?[a-zA-Z][)）])\s*\S")
    tokens = F.size(F.split(line, r"\s+"))
    numbers = _count(line, r"(?<!\S)(?:[-+$€]?\p{N}[\p{N}.,:–-]*%?|n/a)(?!\S)")
    rows = (numbers >= 1) & (numbers >= tokens * 0.3) & (tokens <= 14)
    wide = line.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")
    short = F.when(wide, F.length(line) <= 12).when(line.rlike(r"\p{IsThai}"), F.length(line) <= 18).otherwise((tokens <= 4) & (F.length(line) <= 36))
    shaped = contents | cells | menu
    listed = item & ((F.length(line) <= 80) | F.right(line, F.lit(1)).isin(";", "；"))
    return F.when(F.right(line, F.lit(1)).isin(";", "；"), listed | cells).when(ended, shaped).otherwise(listed | shaped | rows | short)


def statistics(df: DataFrame, key: str, text: str, *kept: str) -> DataFrame:
    """(key, kept columns, script, c_<language>, n_chars, n_words, word_length, symbols, line_ends, common, ends, richness,
    voiceless, longest, structure, bare) of each text that isn't blank: all that needs the text, a narrow row each, made
    where the text is read. script: the language that the script tells, null for Latin script, whose common words are
    counted in c_<language>. bare: has it no words, or few letters among mostly other characters?"""
    rows = df.select(F.col(key).alias("key"), *(F.col(k).alias(f"kept_{k}") for k in kept), F.col(text).alias("raw")).where(r"raw rlike '\\S'")
    # what is left without ASCII letters and spaces, and then without the letters of each script, is short in most texts
    rows = rows.withColumn("ascii", F.length("raw") == F.octet_length("raw")).withColumn("rest_0", F.regexp_replace("raw", "[A-Za-z ]+", ""))
    rows = rows.withColumn("other", ~F.col("ascii") & F.col("rest_0").rlike(r"[^\x00-\x{24F}\x{2000}-\x{206F}]"))
    for k, kind in enumerate(SCRIPTS.values()):
        rows = rows.withColumn(f"rest_{k + 1}", F.when(F.col("other"), F.regexp_replace(f"rest_{k}", f"[{kind}&&[\\p{{L}}&&[^Γ]]]+", "")).otherwise(F.col("rest_0")))
    last = F.col(f"rest_{len(SCRIPTS)}")
    rows = rows.withColumn("odd", ~F.col("ascii") & last.rlike(f"[{SPACES}{UNSEEN}{WIDE}]"))
    rows = rows.withColumn("t", F.when(F.col("odd"), _plain(F.col("raw"))).otherwise(F.col("raw"))).withColumn("rest", F.when(F.col("odd"), F.regexp_replace(_plain(last), "[A-Za-z ]+", "")).otherwise(last))
    rows = rows.withColumn("seen", F.greatest(F.length(F.replace("t", F.lit(" "), F.lit(""))), F.lit(1)))
    rows = rows.withColumns({f"n_{k}": F.when(F.col("other"), F.length(f"rest_{i}") - F.length(f"rest_{i + 1}")).otherwise(0) for i, k in enumerate(SCRIPTS)})
    letters = F.col("seen") - F.length("rest") + F.when(F.col("ascii"), 0).otherwise(_chars(F.col("rest"), r"\p{L}"))
    rows = rows.withColumn("letters", F.greatest(letters, F.lit(1)))
    others = F.col("n_th") + F.col("n_ar") + F.col("n_hi") + F.col("n_ja") + F.col("n_zh")
    latin = F.col("letters") - others - F.col("n_ru") - F.col("n_el") >= F.greatest(others, F.col("n_ru"), F.col("n_el"))
    rows = rows.withColumn("latin", latin).withColumn("t", F.when(F.col("latin") & (F.col("n_ru") + F.col("n_el") > 0), _looks(F.col("t"))).otherwise(F.col("t")))
    western = r"[a-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]+"
    word = F.when(F.col("ascii"), F.expr("regexp_extract_all(lower(t), '[a-z]+', 0)")).when(~F.col("other"), F.expr(f"regexp_extract_all(lower(t), '{western}', 0)")).otherwise(F.expr(r"regexp_extract_all(lower(t), '[\\p{L}\\p{M}]+', 0)"))
    rows = rows.withColumn("w", word).withColumn("n_words", F.size("w"))
    # a row is matched with all lists of its script at once
    among = lambda v: F.size(F.filter("w", lambda x: x.isin(v.split())))
    hits = {k: among(v) for k, v in COMMON.items()}
    # a text that is plainly English isn't matched with the other lists
    rows = rows.withColumn("c_en", F.when(F.col("latin"), hits.pop("en")))
    undecided = F.col("latin") & (F.col("c_en") < F.col("n_words") * 0.15)
    rows = rows.withColumns({f"c_{k}": (F.when(F.col("latin"), F.when(undecided, v).otherwise(0)) if k in LATIN else F.when(F.col(f"n_{k}") > 0, v)) for k, v in hits.items()})
    own = F.when(F.col("n_ja") * 10 >= F.col("n_zh"), F.when(F.col("n_ja") > 0, "ja")).otherwise("zh")
    spaced = F.greatest("n_th", "n_ar", "n_hi", "n_el", "n_ru", F.col("n_ja") + F.col("n_zh"))
    script = reduce(lambda a, k: a.when(F.col(f"n_{k}") == spaced, k), ("th", "ar", "hi", "el", "ru"), F.when(spaced == 0, "en"))
    rows = rows.withColumn("script", F.when(~F.col("latin"), F.coalesce(script, own, F.lit("zh"))))
    seen = F.col("seen")
    # what wrong decoding leaves behind; such words aren't judged
    broken = ~F.col("ascii") & F.col("rest").rlike(r"[^\x00-\x7F]") & (_count(F.col("rest"), r"[\x{80}-\x{9F}\x{A1}-\x{A9}\x{AC}-\x{B8}\x{BC}-\x{BE}\x{C2}\x{C3}\x{D0}-\x{D7}\x{DE}\x{FFFD}\x{2500}-\x{25FF}ÎÏØÙ†‡ˆ‰Œ√∂∞≠ΓÇ]") > seen * 0.06)
    # one or two characters again and again are a filler, not damage
    broken = broken & ~F.col("t").rlike(r"[│┃]") & ~F.col("t").rlike(r"^\s*+([^\s\x{FFFD}])\s*+([^\s\x{FFFD}])(?:\s|\1|\2){6,}+$")
    rows = rows.withColumn("broken", broken)
    common = reduce(lambda a, k: a.when(F.col("script") == k, F.col(f"c_{k}") / F.greatest("n_words", F.lit(1))), (k for k in COMMON if k not in LATIN), F.when(F.lit(False), F.lit(0.0)))
    common = reduce(lambda a, k: a.when(F.col("script") == k, _count(F.col("t"), FUNCTION[k]) / F.col("letters")), FUNCTION, common)
    # structure is judged in damaged texts too, on their ASCII part
    rows = rows.withColumn("t_lines", F.when(F.col("broken"), F.regexp_replace("t", r"[^\x00-\x7F]", "x")).otherwise(F.col("t")))
    rows = rows.withColumn("lines", F.expr(r"filter(transform(split(t_lines, '\n'), x -> trim(BOTH ' \t\r' FROM x)), x -> x != '')"))
    rows = rows.withColumn("kinds", F.transform("lines", lambda x: F.struct(F.length(x).alias("n"), _ends(x).alias("e"), x.alias("x"))))
    size = F.greatest(F.aggregate("kinds", F.lit(0), lambda a, x: a + x["n"]), F.lit(1))
    sound = lambda c: F.when(~F.col("broken"), c)
    judged = lambda c: F.when(~F.col("broken") & (F.col("letters") >= LETTERS), c)
    bare = F.when(F.col("n_words") == 0, True).when(F.col("letters") < LETTERS, (F.col("letters") + _chars(F.col("rest"), r"\p{N}")) * 2 < F.col("seen")).otherwise(False)
    without_spaces = F.coalesce(F.col("script").isin("zh", "ja", "th"), F.lit(False))
    best = F.greatest(*(F.col(f"c_{k}") for k in LATIN))
    narrow = {
        "word_length": judged(F.when(without_spaces, None).otherwise(F.col("letters") / F.greatest("n_words", F.lit(1)))),
        "symbols": sound(_chars(F.col("rest"), r"[^\p{L}\p{M}\s.,!?;:'\"’“”«»()¿¡。，、！？：；（）「」؟،।…–—-]") / seen),
        "line_ends": F.size(F.filter("kinds", lambda x: x["e"])) / F.greatest(F.size("kinds"), F.lit(1)),
        "common": judged(common),
        "ends": judged(F.when(F.col("script") == "th", None).otherwise(100 * _count(F.col("t"), r"[.!?…;。！？؟।](?:(?<=[。！？؟।])|(?<=[\p{L}\p{M}\p{N}%\"”’»)].)(?=[\s\"”’»)」』）]|$))") / F.col("letters"))),
        "richness": judged(F.when(F.col("n_words") >= 8, F.log(F.size(F.array_distinct("w"))) / F.log(F.col("n_words")))),
        "voiceless": judged(F.when(F.col("latin") & (F.coalesce(best, F.lit(0)) > F.col("n_words") * 0.15), 0.0).when(F.col("latin"), F.size(F.filter("w", lambda x: ~x.rlike("[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ]") & (F.length(x) > 1))) / F.greatest("n_words", F.lit(1)))),
        "longest": sound(F.when(~without_spaces, F.array_max(F.transform(F.split("t", r"\s+"), lambda x: F.length(x))))),
        "structure": F.aggregate(F.filter("kinds", lambda x: _structured(x["x"], x["e"])), F.lit(0), lambda a, x: a + x["n"]) / size,
    }
    return rows.select("key", *(F.col(f"kept_{k}").alias(k) for k in kept), "script", *(f"c_{k}" for k in LATIN), F.length("t").alias("n_chars"), "n_words", *(v.cast("float").alias(k) for k, v in narrow.items()), (judged(F.lit(True)).isNotNull()).alias("judged"), F.coalesce(sound(bare), F.lit(False)).alias("bare"))


def in_language(stats: DataFrame, said: str) -> DataFrame:
    """Adds lang, and the share of its common words, from what the text tells and from the column ``said``, which may be null:
    the script's language, or the one whose common words are most frequent; what is said decides only between equals and
    where too few of them stand in the text."""
    best = F.greatest(*(F.col(f"c_{k}") for k in LATIN))
    western = F.when(best >= F.greatest(F.lit(2), F.col("n_words") * 0.04), F.coalesce(*(F.when((F.col(said) == k) & (F.col(f"c_{k}") == best), k) for k in LATIN), *(F.when(F.col(f"c_{k}") == best, k) for k in LATIN))).otherwise(F.coalesce(F.when(F.col(said).isin(*LATIN), F.col(said)), F.lit("en")))
    hits = reduce(lambda a, k: a.when(F.col("_lang") == k, F.col(f"c_{k}")), LATIN, F.when(F.lit(False), F.lit(0)))
    common = F.when(F.col("script").isNotNull(), F.col("common")).when(F.col("judged"), (hits / F.greatest("n_words", F.lit(1))).cast("float"))
    return stats.withColumn("_lang", F.coalesce("script", western)).withColumn("common", common).withColumn("lang", F.col("_lang")).drop("_lang", "script", "judged", *(f"c_{k}" for k in LATIN))


def sketches(stats: DataFrame) -> DataFrame:
    """A KLL sketch of each statistic, by language. Sketches of parts of the data merge with kll_sketch_merge_double."""
    return stats.groupBy("lang").agg(*(F.expr(f"kll_sketch_agg_double(cast({s} as double))").alias(s) for s in (*TAILS, *SHOWN)))


def robust_z(stats: DataFrame, sketched: DataFrame) -> DataFrame:
    """Adds z_<statistic>: how far a value lies in the junk direction. The sketches are one row a language, and languages
    are a fixed list, so that table is broadcast."""
    norms = []
    for s, (low, least) in (TAILS | SHOWN).items():
        q = lambda r, s=s: f"kll_sketch_get_quantile_double({s}, {r})"
        spread = f"({q(0.85)} - {q(0.5)})" if low else f"({q(0.5)} - {q(0.15)})"
        norms += [F.expr(f"if(kll_sketch_get_n_double({s}) > 0, {q(0.5)}, null)").alias(f"m_{s}"), F.expr(f"if(kll_sketch_get_n_double({s}) > 0, greatest({spread}, {least}D), null)").alias(f"s_{s}")]
    out = stats.join(F.broadcast(sketched.select("lang", *norms)), "lang")
    return out.withColumns({f"z_{s}": ((F.col(f"m_{s}") - F.col(s)) if low else (F.col(s) - F.col(f"m_{s}"))) / F.col(f"s_{s}") for s, (low, _) in (TAILS | SHOWN).items()})


def scored(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """The statistics with their robust z and the verdict ``junk``."""
    return judged_rows(in_language(statistics(df, key, text, lang).withColumnRenamed(lang, "_said").dropDuplicates(["key"]), "_said").drop("_said"))


def judged_rows(stats: DataFrame) -> DataFrame:
    """Adds the robust z of each statistic and the verdict ``junk``."""
    # a row a text of about a hundred bytes, read once for the sketches and once for the verdicts
    stats = stats.persist(StorageLevel.MEMORY_AND_DISK)
    z = robust_z(stats, sketches(stats))
    words = [F.coalesce(F.col(f"z_{s}"), F.lit(0.0)) for s in JUDGED]
    tails = sum((w > TAIL_Z).cast("int") for w in words)
    total = sum(F.least(F.greatest(w, F.lit(0.0)), F.lit(6.0)) for w in words)
    # sentences that end speak for prose, if it isn't punctuation all over; a few words say too little
    ended = F.coalesce(-F.col("z_ends"), F.lit(0.0))
    total = total - F.when(F.coalesce(F.col("z_symbols"), F.lit(0.0)) < 5, 2 * F.greatest(F.least(ended, F.lit(4.0)), F.lit(0.0))).otherwise(0.0)
    total = F.when((F.col("n_words") >= 8) | F.col("lang").isin(*FUNCTION) | (F.coalesce(F.col("z_longest"), F.lit(0.0)) > TAIL_Z), total).otherwise(0.0)
    filler = F.col("bare") & ((F.col("n_words") == 0) | (F.coalesce(F.greatest("z_symbols", "z_longest"), F.lit(0.0)) > TAIL_Z))
    return z.withColumn("tails", tails).withColumn("total", total).withColumn("junk", filler | (F.col("z_structure") > STRUCTURE_Z) | ((F.col("tails") >= 2) & (F.col("total") > 9)) | ((F.col("tails") >= 1) & (F.col("total") > 10.5)))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """The verdicts on the chunks. Only the narrow rows are shuffled: once by chunk, and by document where docs is too large
    to be broadcast."""
    stats = statistics(table(spark, folder, "chunks").select("chunk_id", "doc_id", "content"), "chunk_id", "content", "doc_id").dropDuplicates(["key"])
    langs = table(spark, folder, "docs").select("doc_id", F.col("lang").alias("said")).dropDuplicates(["doc_id"])
    return judged_rows(in_language(stats.join(langs, "doc_id", "left").drop("doc_id"), "said").drop("said"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).where("junk").select(F.col("key").alias("chunk_id"))


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).withColumnRenamed("key", "chunk_id")


QUERIES = {"p1_found": p1_found, "p1_statistics": p1_statistics}
ORACLE: dict[str, str] = {}
