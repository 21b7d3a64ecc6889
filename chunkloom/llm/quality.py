"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself: lines that look like navigation, boilerplate or
symbol noise, or that break off without punctuation, fail and are removed. A
document that loses too large a share of its characters this way is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, WORD_CLASS, word_array

#: What a finished sentence ends with (closing quotes and brackets may follow).
TERMINAL = r"""[.!?…;:。！？]["'”’»)\]]*$"""
#: Words that menus are made of, in four languages, in lower case.
NAVIGATION_WORDS = (
    "home|about|about us|contact|contact us|login|log in|sign in|sign up|register|menu|search|next|previous|back|top|sitemap|share|tweet|subscribe|read more|more|click here|skip to content"
    "|startseite|über uns|kontakt|impressum|anmelden|registrieren|menü|suche|weiter|zurück|nach oben|teilen|mehr|mehr lesen|zum inhalt"
    "|accueil|à propos|connexion|s'inscrire|recherche|suivant|précédent|retour|haut de page|partager|lire la suite|plus|aller au contenu"
    "|inicio|acerca de|contacto|iniciar sesión|registrarse|menú|buscar|siguiente|anterior|volver|arriba|compartir|leer más|más|ir al contenido"
)
#: Phrases of notices that are not part of a text, in lower case.
BOILERPLATE = [
    "rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "accept cookies", "accept all cookies", "enable javascript", "copyright ©", "powered by", "lorem ipsum",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "javascript aktivieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "activer javascript",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aceptar cookies", "activar javascript",
]


@dataclass(frozen=True)
class LineRules:
    """Parameters of the rules.

    short_words: an unpunctuated line needs at least so many words to be kept as prose.
    symbol_share: per cent of a line's characters that may be symbols.
    max_lost: per cent of a document's characters that may be removed before it is rejected.
    """

    short_words: int = 5
    symbol_share: int = 10
    max_lost: int = 50


def count_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))


def navigation_pattern() -> str:
    sp = SPACE_CLASS
    return rf"^{sp}*(?:[|»«>•·*\-]{sp}*)?(?:{NAVIGATION_WORDS})(?:{sp}*[|»«>•·/\-]{sp}*(?:{NAVIGATION_WORDS}))*{sp}*$"


def line_is_navigation(low: Column) -> Column:
    """A lower-cased line of menu words alone, or one with three or more separators, one in 67 characters at least."""
    marks = F.length(low) - F.length(F.translate(low, "|»•", ""))
    return low.rlike(navigation_pattern()) | ((marks >= 3) & (F.length(low) <= marks * 67))


def line_is_boilerplate(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | low.contains(phrase)
    return found


def line_fails(line: Column, low: Column, rules: LineRules = LineRules()) -> Column:
    """True if a line with words fails; a line without words neither fails nor counts. low: the line in lower case."""
    few_words = ~line.rlike(rf"^{SPACE_CLASS}*+(?:{WORD_CLASS}++{SPACE_CLASS}++){{{rules.short_words - 1}}}{WORD_CLASS}")
    end = F.rtrim(line, F.lit(SPACES))
    unfinished = few_words & (end != "") & ~F.substring(end, -6, 6).rlike(TERMINAL)
    return (count_symbols(line) * 100 > F.length(line) * rules.symbol_share) | line_is_boilerplate(low) | line_is_navigation(low) | unfinished


def with_lines(df: DataFrame, text: str, rules: LineRules) -> DataFrame:
    """Adds cleaned_text, n_lines, n_removed_lines and lost_pct of a text column to a frame without such names."""
    df = df.withColumn("lines_", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    df = df.withColumn("low_", F.transform("lines_", F.lower))
    df = df.withColumn("good_", F.filter("lines_", lambda x, i: ~line_fails(x, F.get(F.col("low_"), i), rules)))
    letters = lambda x: F.length(F.array_join(x, ""))
    df = df.withColumn("all_", letters("lines_")).withColumn("left_", letters("good_"))
    lost = F.when(F.col("all_") > 0, (F.col("all_") - F.col("left_")) * 100.0 / F.col("all_")).otherwise(F.lit(0.0))
    return (
        df.withColumn("cleaned_text", F.when(F.col(text).isNotNull(), F.array_join("good_", "\n")))
        .withColumn("n_lines", F.size("lines_").cast("long"))
        .withColumn("n_removed_lines", (F.size("lines_") - F.size("good_")).cast("long"))
        .withColumn("lost_pct", lost)
        .drop("low_", "good_", "all_", "left_")
    )


ADDED = ["cleaned_text", "n_lines", "n_removed_lines", "lost_pct"]


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Adds cleaned_text, n_lines, n_removed_lines and lost_pct to each row; rows and other columns stay.

    Columns of the input by those names are replaced. A null text gives a null
    cleaned_text and zero counts; an empty or blank text loses nothing.
    """
    own = [c for c in docs.columns if c not in ADDED]
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("text").alias("text_"))
    return with_lines(df, "text_", rules).select("row.*", *ADDED)


#: Places of windows take the low bits of a sort key: 24 suffice for 16 million words, 31 for any array.
PLACE_BITS, PLACE_BITS_LONG = 24, 31


def window_keys(words: Column, bits: Column, window: int = 3) -> Column:
    """For each window of the array the low bits of its hash above its place, as one long.

    Sorted, windows of equal hash are neighbours; no step compares all pairs, and
    the sort is one of primitives. An array shorter than the window has none.
    """
    places = F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))
    shifted = lambda x: F.call_function("shiftleft", x, bits)
    return F.transform(places, lambda i: shifted(F.xxhash64(*(F.get(words, i + k) for k in range(window)))).bitwiseOR(i.cast("long")))


def quality_report(docs: DataFrame, rules: LineRules = LineRules(), keep_text: bool = True) -> DataFrame:
    """The base counts of each document, its line-first verdict and the cleaned text.

    One row per input row, repeated ids included. A null or blank text has no words
    and fails the base test. Lines are parted by \\n alone. Extra columns are not read.
    """
    df = with_lines(docs.select("doc_id", "text"), "text", rules)
    df = df.withColumn("words_", word_array(F.col("text")))
    df = df.withColumn("bits_", F.when(F.size("words_") < (1 << PLACE_BITS), F.lit(PLACE_BITS)).otherwise(F.lit(PLACE_BITS_LONG)))
    df = df.withColumn("keys_", F.sort_array(window_keys(F.col("words_"), F.col("bits_"))))
    alike = lambda x, y: F.coalesce(F.call_function("shiftright", x.bitwiseXOR(y), F.col("bits_")) == 0, F.lit(False))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits_")) - 1).cast("int")
    # windows whose hash bits come again; these alone are sorted by their words, so equal ones are neighbours
    df = df.withColumn("near_", F.filter("keys_", lambda x, i: alike(x, F.get(F.col("keys_"), i + 1)) | alike(x, F.get(F.col("keys_"), i - 1))))
    word = lambda x, k: F.get(F.col("words_"), place(x) + k)
    df = df.withColumn("near_", F.sort_array(F.transform("near_", lambda x: F.struct(F.struct(word(x, 0).alias("a"), word(x, 1).alias("b"), word(x, 2).alias("c")).alias("w"), place(x).alias("p")))))
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    twice = F.filter("near_", lambda x, i: same(x, F.get(F.col("near_"), i - 1)) | same(x, F.get(F.col("near_"), i + 1)))
    df = df.withColumn("at_", F.sort_array(F.transform(twice, lambda x: x["p"])))
    new = F.transform("at_", lambda x, j: F.least(F.lit(3), F.coalesce(F.get(F.col("at_"), j + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(new, F.lit(0), lambda a, x: a + x).cast("long"))
    df = (
        df.withColumn("n_words", F.size("words_").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words_", "")).cast("long"))
        .withColumn("n_symbols", F.coalesce(count_symbols(F.col("text")), F.lit(0)).cast("long"))
        .withColumn("real_", F.filter("lines_", lambda x: F.btrim(x, F.lit(SPACES)) != ""))
        .withColumn("n_dup_lines", (F.size("real_") - F.size(F.array_distinct("real_"))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_pct") <= rules.max_lost))
    )
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_removed_lines", "lost_pct"]
    return df.select(*out, *(["cleaned_text"] if keep_text else []))
