"""Text functions as column expressions: normalisation, tokens, stems and set similarities, all on the JVM side.

Every function maps null text to null or to an empty list, and an empty text to an empty text or list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternq.functions.constants import BOILERPLATE, INTERROGATIVES, STOPWORDS, TOKEN

#: Fixed value: white space, as a regular expression's character class.
SPACE = r" \t-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(text: Column | str) -> Column:
    """Line ends to LF, tabs and no-break spaces to spaces, runs of spaces to two (a column gap), no space at line
    ends, at most one blank line in a row, none at the ends."""
    x = F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))
    x = F.translate(x, "\r ​", "\n ")
    x = F.regexp_replace(F.replace(x, F.lit("\t"), F.lit(" ")), " {2,}", "  ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?m)[ ]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\n+|\n+$", "")


def normalize_text(text: Column | str) -> Column:
    """Compatibility forms (NFKC), case folding, single spaces. Pure ASCII takes the short way; other texts go
    through the Unicode library that Spark ships, so all of it stays in the JVM."""
    c = _col(text)
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    full = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    plain = F.when(c.isNull(), c).when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(full)
    return F.trim(F.regexp_replace(plain, f"[{SPACE}]+", " "))


def tokens(text: Column | str, drop_stopwords: bool = False) -> Column:
    """The tokens in order; identifiers stay whole."""
    found = F.regexp_extract_all(normalize_text(text), F.lit(TOKEN), F.lit(0))
    return without_stopwords(found) if drop_stopwords else found


def without_stopwords(words: Column | str) -> Column:
    """The words that are no stopwords."""
    return F.filter(_col(words), lambda t: ~t.isin(*STOPWORDS))


def token_set(text: Column | str, drop_stopwords: bool = True) -> Column:
    """P5: the distinct tokens."""
    return F.array_distinct(tokens(text, drop_stopwords))


def light_stem(t: Column) -> Column:
    """Plurals to singulars; short words and words with a digit or hyphen stay."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n <= 3) | t.rlike(r"[0-9-]"), t)
        .when(t.rlike("ies$") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(t.rlike("sses$"), cut(2))
        .when(t.rlike("(s|x|z|ch|sh)es$"), cut(2))
        .when(t.rlike("s$") & ~t.rlike("(ss|us|is)$"), cut(1))
        .otherwise(t)
    )


def stems(words: Column | str) -> Column:
    """The distinct stems of a list of words."""
    return F.array_distinct(F.transform(_col(words), light_stem))


def coverage(query_stems: Column | str, text_stems: Column | str) -> Column:
    """The share of the query's stems that the text has; 0 for an empty query."""
    q = _col(query_stems)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, _col(text_stems))) / F.size(q)).otherwise(F.lit(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all; 0 if either is empty."""
    a, b = F.array_distinct(_col(a)), F.array_distinct(_col(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Shared over the smaller; 0 if either is empty."""
    a, b = F.array_distinct(_col(a)), F.array_distinct(_col(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def word_ngrams(words: Column | str, n: int) -> Column:
    """The runs of ``n`` successive words of a list, each joined by a space; none if it is shorter."""
    w = _col(words)
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))


def char_ngrams(text: Column | str, n: int) -> Column:
    """P10: character n-grams of the normalised text between two spaces; the whole, if it is shorter."""
    padded = F.concat(F.lit(" "), normalize_text(text), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(padded) < n, F.array(padded)).otherwise(grams)


def doc_key(text: Column | str, source: Column | str) -> Column:
    """16 hex digits of a document's normalised text and source."""
    return F.substring(F.sha2(F.concat(normalize_text(text), F.lit("\0"), F.coalesce(_col(source), F.lit(""))), 256), 1, 16)


def chunk_key(doc: Column | str, index: Column | str, text: Column | str) -> Column:
    """A chunk's key from its document's key, its number and text."""
    doc = _col(doc)
    return F.concat(F.substring(doc, 1, 8), F.lit("-"), F.substring(F.sha1(F.concat(doc, F.lit("\0"), _col(index).cast("string"), F.lit("\0"), _col(text))), 1, 10))


def without_boilerplate(text: Column | str, patterns: tuple[str, ...] = BOILERPLATE) -> Column:
    """The text without lines of page furniture."""
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(F.split(_col(text), "\n"), lambda line: ~line.rlike(pattern)), "\n")


def first_heading(text: Column | str) -> Column:
    """The first non-blank line without its heading marks, else its first 80 characters."""
    line = F.trim(F.regexp_extract(_col(text), r"([^\n]*[^\s][^\n]*)", 1))
    return F.when(line.startswith("#"), F.trim(F.regexp_replace(line, "^#+", ""))).otherwise(F.substring(line, 1, 80))


def qa_markdown(question: Column | str, answer: Column | str) -> Column:
    """A question-answer pair as a section."""
    return F.concat(F.lit("## "), strip(F.regexp_replace(_col(question), "\n", " ")), F.lit("\n\n"), strip(_col(answer)))


def first_filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def chunk_label(breadcrumb: Column | str, title: Column | str, source: Column | str, chunk_id: Column | str) -> Column:
    """What a chunk is called: its breadcrumb, else title, source or key."""
    return F.coalesce(F.nullif(F.array_join(_col(breadcrumb), " > "), F.lit("")), F.nullif(_col(title), F.lit("")), F.nullif(_col(source), F.lit("")), _col(chunk_id))


def clamp(x: Column) -> Column:
    """Into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def is_question(heading: Column | str) -> Column:
    """Whether a heading asks: it ends with a question mark, has a question's prefix (with a sign and a text behind
    it), or starts with an interrogative."""
    h = strip(heading)
    return F.coalesce(h.endswith("?") | h.rlike(r"(?is)^(?:q|question)\s*[:.)-]\s*.+") | h.rlike(rf"(?i)^(?:{'|'.join(INTERROGATIVES)})\b"), F.lit(False))
