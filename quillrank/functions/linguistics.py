"""Counts and ratios of the language of a text, as column expressions that pass over the whole text.

A word is a run of ASCII letters, digits and apostrophes between word boundaries, where every letter, digit and underscore of any alphabet belongs to a
word: "café" holds none, as its last letter can't stand in one, "d'où" holds "d'", and "x_y" none. Word boundaries are spelled out, as engines
differ in what theirs are. What has no value (a mean over no words, anything of a null or blank text) is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# What belongs to words, white space but line ends, signs of bullets, and punctuation.
IN_WORD = r"\p{L}\p{N}_"
SPACE = r" \t\x0B\f\r\x1c-\x1f\x{85}\p{Z}"
BULLET_SIGNS = "\\-\u2022*\u2013"
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def said(text: Column) -> Column:
    """text, or null if it is blank."""
    return F.when(text.rlike(rf"[^\n{SPACE}]"), text)


def flat(text: Column) -> Column:
    """The words of text between single or repeated spaces."""
    runs = F.regexp_replace(text, f"[^{IN_WORD}']+", " ")
    trimmed = F.regexp_replace(runs, "(?<![^ ])'++|(?<!')'++(?![^ ])", "")
    return F.regexp_replace(trimmed, rf"(?<![a-zA-Z0-9])[a-zA-Z0-9]*+[{IN_WORD}&&[^a-zA-Z0-9]][{IN_WORD}]*+", " ")


def split_words(flat_text: Column) -> Column:
    return F.array_remove(F.split(flat_text, " "), "")


def lettered(flat_text: Column) -> Column:
    """flat() text without the words that hold no letter."""
    return F.regexp_replace(flat_text, "(?<![^ ])[0-9']++(?![^ ])", "")


def count_sentences(text: Column) -> Column:
    """Parts between marks that hold more than white space."""
    return F.regexp_count(text, F.lit(rf"[^.!?\n{SPACE}][^.!?]*+"))


def count_characters(text: Column) -> Column:
    return F.length(F.translate(text, " \n", ""))


def count_punctuation(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))


def count_bullets(text: Column) -> Column:
    """Lines that begin with a bullet sign, and numbers with a dot and white space after them, wherever they stand."""
    signs = F.regexp_count(text, F.lit(rf"(?md)^[{SPACE}]*+[{BULLET_SIGNS}]"))
    return signs + F.regexp_count(text, F.lit(rf"(?<![{IN_WORD}])\p{{Nd}}++\.[\n{SPACE}]"))


def count_syllables(lettered_text: Column) -> Column:
    """Groups of vowels of each word after its final e's are cut, one at least, summed over lettered() text."""
    low = F.lower(lettered_text)
    cut = F.regexp_replace(low, "(?<!e)e++(?![^ ])", "")
    voiced = F.regexp_count(cut, F.lit("(?<![^ ])[^ aeiou]*+[aeiou]"))
    return F.regexp_count(cut, F.lit("[aeiou]++")) + F.size(split_words(low)) - voiced


def count_verbs(text: Column, verbs: list[str] = X.ACTION_VERBS) -> Column:
    """How often one of verbs stands as a whole word, in either case."""
    return F.size(F.filter(F.split(F.lower(text), f"[^{IN_WORD}]+"), lambda w: w.isin(*verbs)))


def content_words(text: Column) -> Column:
    """Whole words of a-z of the text in lower case, in order, without stop words."""
    plain = F.regexp_replace(F.lower(text), rf"(?<![{IN_WORD}])[a-z]*+[{IN_WORD}&&[^a-z]][{IN_WORD}]*+", " ")
    return F.filter(F.split(plain, "[^a-z]+"), lambda w: (w != "") & ~w.isin(*X.STOP_WORDS))


FEATURES = "word_count sentence_count char_count avg_word_len avg_sentence_len type_token_ratio hapax_ratio stopword_ratio number_ratio uppercase_ratio avg_syllables_per_word flesch_reading_ease punctuation_density bullet_count".split()


def features(rows: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """rows with the fourteen FEATURES of a text column, each named prefix_feature, and prefix_punctuation, prefix_syllables and prefix_distinct."""
    t = F.col("_text")
    rows = rows.withColumn("_text", said(F.col(text_col))).withColumn("_flat", flat(t))
    rows = rows.withColumns({"_lettered": lettered(F.col("_flat")), "_words": split_words(F.col("_flat"))})
    rows = rows.withColumns({"_low": F.transform("_words", lambda w: F.lower(w)), "_n": F.size("_words"), "_own": F.size(split_words(F.col("_lettered")))})
    rows = rows.withColumns({"_sentences": count_sentences(t), "_chars": count_characters(t), "_marks": count_punctuation(t), "_syllables": count_syllables(F.col("_lettered")), "_distinct": F.size(F.array_distinct("_low"))})
    n = F.when(F.col("_n") > 0, F.col("_n"))
    own = F.when(F.col("_own") > 0, F.col("_own"))
    per_sentence = F.col("_n") / F.greatest(F.col("_sentences"), F.lit(1))
    per_word = F.col("_syllables") / own
    ease = 206.835 - 1.015 * per_sentence - 84.6 * per_word
    made = {
        "word_count": F.col("_n"),
        "sentence_count": F.col("_sentences"),
        "char_count": F.col("_chars"),
        "avg_word_len": F.length(F.translate("_lettered", " ", "")) / own,
        "avg_sentence_len": per_sentence,
        "type_token_ratio": F.col("_distinct") / n,
        "hapax_ratio": X.hapaxes(F.col("_low")) / n,
        "stopword_ratio": F.size(F.filter("_low", lambda w: w.isin(*X.STOP_WORDS))) / n,
        "number_ratio": F.size(F.filter("_words", lambda w: w.rlike("^[0-9]+$"))) / n,
        "uppercase_ratio": X.capitals(F.col("_words")) / n,
        "avg_syllables_per_word": per_word,
        "flesch_reading_ease": F.when(ease.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease))),
        "punctuation_density": F.col("_marks") / F.when(F.col("_chars") > 0, F.col("_chars")),
        "bullet_count": count_bullets(t),
        "punctuation": F.col("_marks"),
        "syllables": F.col("_syllables"),
        "distinct": F.col("_distinct"),
    }
    known = t.isNotNull()  # size() of null is no null in every mode
    rows = rows.withColumns({f"{prefix}_{k}": F.when(known, c) for k, c in made.items()})
    return rows.drop(*(c for c in rows.columns if c.startswith("_") and c in ("_text", "_flat", "_lettered", "_words", "_low", "_n", "_own", "_sentences", "_chars", "_marks", "_syllables", "_distinct")))


def overlap(first: Column, second: Column) -> dict[str, Column]:
    """token_jaccard, jd_coverage (of second's content words, the share that first holds) and bigram_jaccard (pairs of neighbours in the
    order of the text). Null where the divisor is 0 or a text is null. with_overlap() makes the same, each list of words once."""
    return overlap_of(*(f(c) for f in (lambda c: F.array_distinct(content_words(c)), lambda c: X.bigrams(content_words(c))) for c in (first, second)))


def overlap_of(x: Column, y: Column, p: Column, q: Column) -> dict[str, Column]:
    """overlap() out of both texts' distinct content words and distinct pairs of neighbours, which are null for a null text."""
    both = x.isNotNull() & y.isNotNull()
    words, pairs = F.size(F.array_intersect(x, y)), F.size(F.array_intersect(p, q))
    share = lambda n, whole: n / F.when(whole > 0, whole)
    made = {"token_jaccard": share(words, F.size(x) + F.size(y) - words), "jd_coverage": share(words, F.size(y)), "bigram_jaccard": share(pairs, F.size(p) + F.size(q) - pairs)}
    return {k: F.when(both, c) for k, c in made.items()}


def with_overlap(rows: DataFrame, first: str, second: str, prefix: str = "", worded: bool = False) -> DataFrame:
    """rows with overlap() of two text columns, or of content_words() of them. Each step is a column of its own, so that none is evaluated again where it is used."""
    rows = rows.withColumns({"_a": F.col(first) if worded else content_words(F.col(first)), "_b": F.col(second) if worded else content_words(F.col(second))})
    rows = rows.withColumns({"_x": F.array_distinct("_a"), "_y": F.array_distinct("_b"), "_p": X.bigrams(F.col("_a")), "_q": X.bigrams(F.col("_b"))})
    made = overlap_of(*(F.col(c) for c in ("_x", "_y", "_p", "_q")))
    return rows.withColumns({f"{prefix}{k}": c for k, c in made.items()}).drop("_a", "_b", "_x", "_y", "_p", "_q")
