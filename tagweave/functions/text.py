"""Scalar column functions: cleaning, tokens, per-row term counts, escaping.

All of them are built from ``pyspark.sql.functions`` (JVM side); none calls
Python per row. Array work uses Spark's higher-order functions so that a
document's counts are computed inside its own row, without a shuffle.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's behaviour.
#
# English stop words of the NLTK corpus, in its published order (179 words),
# then the four interface words the tagging service appends.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
)
UI_STOP_WORDS = ("button", "submit", "menu", "login")
DEFAULT_STOP_WORDS = ENGLISH_STOP_WORDS + UI_STOP_WORDS

# ASCII punctuation the cleaner deletes (Python's string.punctuation).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_PUNCTUATION_CLASS = "".join("\\" + c for c in ASCII_PUNCTUATION)

# The characters Python's \s matches in text patterns (str.isspace), written as
# a class body that both Java regex and RE2 read the same way.
PY_SPACE_CLASS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
                  r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# Python's \w for text: letters, numbers and underscore.
WORD_CLASS = r"\p{L}\p{N}_"

# Labels of the entity model that the tagger never reports.
DROPPED_ENTITY_LABELS = ("CARDINAL", "ORDINAL")

# Page URLs the extension skips.
INTERNAL_URL_PREFIXES = ("chrome-extension://", "devtools://", "browser://", "chrome://")
# End of fixed values.
# ---------------------------------------------------------------------------


def _lit_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalize_text(col: Column) -> Column:
    """Cleaning steps before tokenising, in the reference's order.

    null → '' ; lower ; drop '{html}' ; '<…>' → blank (not across a newline) ;
    drop 'http' and the non-blanks after it ; newline → blank ; drop ASCII
    digits ; drop ASCII punctuation ; carriage return → blank.
    """
    s = F.lower(F.coalesce(col, F.lit("")))
    s = F.replace(s, F.lit("{html}"), F.lit(""))
    s = F.regexp_replace(s, r"(?d)<.*?>", " ")
    s = F.regexp_replace(s, "http[^" + PY_SPACE_CLASS + "]+", "")
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    s = F.regexp_replace(s, "[0-9" + _PUNCTUATION_CLASS + "]+", "")   # two deletions of single characters in one scan
    return F.replace(s, F.lit("\r"), F.lit(" "))


def word_tokens(col: Column) -> Column:
    """Maximal runs of word characters (Python's ``\\w+``); most are a-z, which a range tells faster than a category."""
    return F.regexp_extract_all(col, F.lit("[a-z" + WORD_CLASS + "]++"), 0)


def keep_tokens(tokens: Column, stop_words: Iterable[str] | None = DEFAULT_STOP_WORDS,
                min_len: int = 3) -> Column:
    """Token filter: at least ``min_len`` code points and not a stop word."""
    stop = tuple(stop_words or ())
    if stop:   # isin: Spark looks a long list up in a hash set, array_contains compares with every word
        return F.filter(tokens, lambda w: (F.length(w) >= min_len) & ~w.isin(*stop))
    return F.filter(tokens, lambda w: F.length(w) >= min_len)


def clean_tokens(col: Column, stop_words: Iterable[str] | None = DEFAULT_STOP_WORDS) -> Column:
    """The reference's ``preprocess`` without lemmas, as a token array."""
    return keep_tokens(word_tokens(normalize_text(col)), stop_words)


def clean_text(col: Column, stop_words: Iterable[str] | None = DEFAULT_STOP_WORDS) -> Column:
    """The reference's ``preprocess`` without lemmas: cleaned tokens joined by blanks."""
    return F.array_join(clean_tokens(col, stop_words), " ")


def with_term_counts(df: DataFrame, tokens: str, out: str = "tf") -> DataFrame:
    """Add the row's bag of words: ``array<struct<term string, tf int>>`` sorted by term.

    Sorts the tokens once (native ``sort_array``) and reads run boundaries, so
    it costs O(n log n) inside the row and needs no shuffle, where a
    ``groupBy(doc_id, term)`` would shuffle. The sorted array and the run
    starts are kept as their own columns so the lambdas read them instead of
    re-sorting per element.
    """
    s, st = "__tw_sorted", "__tw_starts"
    n = F.size(F.col(s))
    return (df
            .withColumn(s, F.sort_array(F.col(tokens)))
            .withColumn(st, F.filter(
                F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                lambda i: (i == 0) | (F.get(F.col(s), i) != F.get(F.col(s), i - 1))))
            .withColumn(out, F.transform(
                F.col(st),
                lambda b, k: F.struct(
                    F.get(F.col(s), b).alias("term"),
                    (F.coalesce(F.get(F.col(st), k + 1), n) - b).cast("int").alias("tf"))))
            .drop(s, st))


def _ngram_list(tokens: Column, n: int) -> Column:
    m = F.size(tokens) - n + 1
    if n == 2:   # two words are put together without an array for each
        return (F.when(m > 0, F.zip_with(F.slice(tokens, 1, m), F.slice(tokens, 2, m), lambda a, b: F.concat(a, F.lit(" "), b)))
                .otherwise(F.array().cast("array<string>")))
    return (F.when(m > 0, F.transform(F.sequence(F.lit(1), m),
                                      lambda i: F.array_join(F.slice(tokens, i, n), " ")))
            .otherwise(F.array().cast("array<string>")))


def word_ngrams(tokens: Column, lo: int = 1, hi: int = 1) -> Column:
    """Word n-grams for n in [lo, hi], joined by a blank, n ascending then position."""
    parts = [tokens if n == 1 else _ngram_list(tokens, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def escape_html(col: Column) -> Column:
    """HTML escape of & < > " ' in that order (``'`` → ``&#039;``)."""
    s = F.replace(col, F.lit("&"), F.lit("&amp;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    s = F.replace(s, F.lit(">"), F.lit("&gt;"))
    s = F.replace(s, F.lit('"'), F.lit("&quot;"))
    return F.replace(s, F.lit("'"), F.lit("&#039;"))


def capitalize(col: Column) -> Column:
    """Python's ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def explode_structs(df: DataFrame, arr: str, keep: list[str], pos: str | None = None) -> DataFrame:
    """One row per element of ``arr`` (struct fields become columns), empty arrays give no row.

    Uses the outer generators and drops their null row afterwards: a plain
    ``inline`` / ``posexplode`` makes Catalyst infer ``size(arr) > 0`` and push
    it below the projection, where it would recompute the whole array
    expression (cleaning, sorting) once more per reference.
    """
    if pos:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos, "__e")).where(F.col(pos).isNotNull())
        return out.select(*keep, pos, "__e.*")
    return df.select(*keep, F.explode_outer(arr).alias("__e")).where(F.col("__e").isNotNull()) \
             .select(*keep, "__e.*")


def remove_stop_words(col: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """F8: split on blanks, drop words whose lower case is a stop word, join by one blank."""
    stop = tuple(stop_words)
    words = F.filter(F.split(F.trim(F.coalesce(col, F.lit(""))), "[" + PY_SPACE_CLASS + "]+"),
                     lambda w: (w != "") & ~F.lower(w).isin(*stop))
    return F.array_join(words, " ")


def script_clean(col: Column, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """X11: lower, drop digit runs, drop newlines and backslashes, drop non-word non-blank
    characters, then drop stop words (the extractor script's cleaning)."""
    s = F.lower(F.coalesce(col, F.lit("")))
    s = F.regexp_replace(s, r"\p{Nd}+", "")
    s = F.regexp_replace(s, r"[\n\\]", "")
    s = F.regexp_replace(s, "[^" + WORD_CLASS + PY_SPACE_CLASS + "]", "")
    return remove_stop_words(s, stop_words)
