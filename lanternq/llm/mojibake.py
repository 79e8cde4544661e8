"""Text decoded with the wrong encoding (problem 6): garbled forms of every clean corpus word, hash-joined to tokens.

An encoding error leaves ASCII as it is and turns every run of other characters into another such run. So the clean
words of the corpus, and their non-ASCII runs, are garbled under all chains; the documents' tokens and runs are joined
against that table. Chains through UTF-8 give runs that clean text does not hold, so runs suffice; chains between
single-byte encodings give ordinary letters, so only whole words count there, and only in documents whose words, taken
together, stand in twice as many texts in their clean as in their garbled form. Copies of a text count once."""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternq.plans.scale import cut, digest, salted_join

#: Single-byte encodings in which text is commonly misread, and those in which it is commonly stored.
READ_AS = ("latin_1", "cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "mac_cyrillic", "iso8859_2", "iso8859_15", "cp1254")
STORED_AS = ("cp1252", "cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850", "iso8859_5", "mac_cyrillic")
TWICE = ("latin_1", "cp1252", "cp1251", "mac_roman", "cp437")
LOST = "�"
TOKEN = r"[^\s]*[^\x00-\x7F][^\s]*"
#: A clean word: letters of one script with inner apostrophes or hyphens, bare or in typographic quotes; or one symbol.
CLEAN = regex.compile(r"[“„«‘(¿¡]*(?:(?:\p{Latin}|\p{N})+(?:[’'\-–](?:\p{Latin}|\p{N})+)*|\p{Cyrillic}+(?:-\p{Cyrillic}+)*|\p{N}*[–—…·°™½×±•“”‘’«»€£©®¿¡≤≥⌀]+C?\p{N}*)[”“»’….,:;!?)™]*")
#: Cyrillic letters that Russian does not use stand in garbled words, not in clean ones.
FOREIGN = regex.compile(r"[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї]|\p{Ll}\p{Lu}|\p{Cc}")
RUNS = regex.compile(r"[^\x00-\x7F]+")
LETTERS = regex.compile(r"[A-Za-z]|\p{Cyrillic}{3}")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
QUOTES = "'\"`“”‘’«»„()[]"


@lru_cache(None)
def _table(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; bytes the encoding leaves undefined stand for the control character of that code."""
    to = {b: codecs.decode(bytes([b]), name, "replace") for b in range(256)}
    to = {b: chr(b) if c == LOST else c for b, c in to.items()}
    return to, {c: b for b, c in reversed(to.items())}


def _decoded(data: bytes, name: str) -> str:
    to = _table(name)[0]
    return "".join([to[b] for b in data])


def _encoded(text: str, name: str) -> bytes | None:
    back = _table(name)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def garbled_forms(word: str) -> dict[str, tuple[str, bool]]:
    """Every garbled form of a word: its chain, and whether the chain runs through UTF-8 bytes."""
    forms: dict[str, tuple[str, bool]] = {}
    utf8 = word.encode("utf-8", "replace")
    for x in READ_AS:
        forms.setdefault(once := _decoded(utf8, x), (f"utf_8>{x}", True))
        if x in TWICE:
            for y in TWICE:
                forms.setdefault(_decoded(once.encode("utf-8", "replace"), y), (f"utf_8>{x}>utf_8>{y}", True))
    for x in STORED_AS:
        if (data := _encoded(word, x)) is not None:
            for y in READ_AS:
                if x != y and LETTERS.search(word):
                    forms.setdefault(_decoded(data, y), (f"{x}>{y}", False))
            forms.setdefault(data.decode("utf-8", "replace"), (f"{x}>utf_8", LOST in data.decode("utf-8", "replace")))
    forms.pop(word, None)
    return forms


def is_clean(token: str) -> bool:
    return bool(CLEAN.fullmatch(token)) and not FOREIGN.search(token)


def _garble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for word, n in zip(batch["token"], batch["n"], strict=True):
            core = word.strip(EDGE)
            if not is_clean(core):
                continue
            rows += [(g, core, chain, multi, True, n) for g, (chain, multi) in garbled_forms(core).items()]
            for run in set(RUNS.findall(core)) - {core}:
                rows += [(g, run, chain, True, False, n) for g, (chain, multi) in garbled_forms(run).items() if multi and len(g) > 1 and set(g) != {LOST}]
        yield pd.DataFrame(rows, columns=["form", "original", "chain", "multi", "word", "n"])


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys by which a token is looked up: its core, and its runs."""
    for batch in batches:
        rows = []
        for token in batch["token"]:
            core = token.strip(EDGE)
            runs = RUNS.findall(core)
            rows.append((token, core, True))
            rows += [(token, r, False) for r in dict.fromkeys(runs)]
            if LOST in core and regex.search(r"\p{L}�|�\p{L}", core):
                rows.append((token, LOST, False))
        yield pd.DataFrame(rows, columns=["token", "key", "is_word"])


def document_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, h, token, n``: the distinct tokens with a character beyond ASCII, and how often each stands there.
    ``h`` is the same for copies of a text that differ in nothing but case, punctuation and white space."""
    bare = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    some = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text", bare.alias("bare")).select("doc_id", "text", F.struct(*digest(F.col("bare"))).alias("h"))
    each = some.select("doc_id", "h", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    return each.groupBy("doc_id", "h", "token").agg(F.count("*").alias("n"))


def garbled_tokens(tokens: DataFrame) -> DataFrame:
    """``token, sure, maybe``: corpus tokens that are, or hold, a garbled form of a clean corpus word. ``sure`` is the
    best of the originals through UTF-8 or lost (or null), ``maybe`` are those through single-byte encodings, one for
    each encoding the text was stored in, with ``odds``: the logarithm of the number of distinct texts that hold the
    original over those that hold the form."""
    vocab = tokens.select("token").distinct()
    keys = cut(vocab.mapInPandas(_keys, "token string, key string, is_word boolean"))
    words = cut(tokens.select(F.btrim("token", F.lit(EDGE)).alias("key"), "h").distinct().groupBy("key").agg(F.count("*").alias("n")))
    clean = words.withColumnRenamed("key", "token").mapInPandas(_garble, "form string, original string, chain string, multi boolean, word boolean, n long")
    totals = words.select(F.col("key"), F.col("n").alias("kn"))
    looked_up = cut(keys.join(totals, "key", "left").withColumnRenamed("key", "form"))
    hits = salted_join(clean, looked_up, ["form"], "original", row_bytes=140).where("multi or (is_word and word)").where("is_word = word or not word")
    # Words of one or two letters stand in too many languages to speak for a chain, only against it: they follow the others.
    odds = F.log(F.col("n") / F.col("kn"))
    odds = F.when(~F.col("multi"), F.when(F.length("original") > 2, odds).otherwise(F.least(F.lit(0.0), odds)))
    hits = hits.select("token", "original", "chain", "form", "n", "multi", odds.alias("odds"))
    lost = keys.where(F.col("key") == LOST).select("token", F.lit(None).cast("string").alias("original"), F.lit("lost").alias("chain"), F.lit("").alias("form"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("multi"), F.lit(None).cast("double").alias("odds"))
    stored = F.when(~F.col("multi"), F.substring_index("chain", ">", 1)).alias("stored")
    rank = F.struct(F.length("form").alias("length"), F.col("n"), F.reverse("original").alias("reversed"))
    best = hits.unionByName(lost).groupBy("token", stored).agg(F.max_by(F.struct("original", "chain", "form", rank.alias("rank"), "odds"), rank).alias("b"))
    one = best.select("token", "stored", F.struct("stored", "b.*", _bare("token", "b.form", "b.original").alias("bare")).alias("b"))
    return one.groupBy("token").agg(F.max(F.when(F.col("stored").isNull(), F.col("b"))).alias("sure"), F.collect_set(F.when(F.col("stored").isNotNull(), F.col("b"))).alias("maybe"))


def garbled_places(docs: DataFrame) -> DataFrame:
    """``doc_id, token, n, original, chain, form, bare``: the garbled tokens of each document. Originals through
    single-byte encodings count where the odds of all words of the document that may come from the same stored
    encoding together are 2:1 at least. Words that are 2:1 the clean side themselves are left out, as they are the
    clean part of a text garbled in part; words that stand as often clean as garbled follow the others."""
    tokens = cut(document_tokens(docs))
    found = cut(salted_join(tokens.drop("h"), cut(garbled_tokens(tokens)), ["token"], "doc_id", row_bytes=300))
    maybe = found.select("doc_id", "token", "n", F.explode("maybe").alias("b")).where(F.col("b.odds") > F.lit(-math.log(2) + 1e-6))
    votes = maybe.select("doc_id", "token", F.col("b.stored").alias("stored"), F.col("b.odds").alias("odds")).distinct().groupBy("doc_id", "stored").agg(F.round(F.sum("odds"), 6).alias("odds"))
    decided = votes.where(F.col("odds") >= round(math.log(2), 6)).select("doc_id", "stored")
    maybe = maybe.withColumn("stored", F.col("b.stored")).join(decided, ["doc_id", "stored"], "left_semi").select("doc_id", "token", "n", "b")
    hits = found.where("sure is not null").select("doc_id", "token", "n", F.col("sure").alias("b")).unionByName(maybe)
    best = hits.groupBy("doc_id", "token").agg(F.max("n").alias("n"), F.max_by("b", "b.rank").alias("b"))
    return best.select("doc_id", "token", "n", "b.original", "b.chain", "b.form", "b.bare")


def _bare(token: str, form: str, original: str) -> Column:
    inner = F.regexp_replace(token, r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E“”‘’«»„]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E“”‘’«»„]+$", "")
    quoted = F.col(token).rlike(r"^['\"`(\[“‘«„].*['\"`)\]”’»“][.,;:!?]?$")
    return F.coalesce(((inner == F.col(form)) | (F.col(token) == F.col(form))) & ((F.length(original) == 1) & F.col(original).rlike(r"\p{L}") | quoted), F.lit(False))


def garbled_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_restorable``: documents that hold garbled text. A document whose only garbled tokens are
    bare letters is one that talks about such signs. Null and pure ASCII texts are never garbled."""
    hits = garbled_places(docs).groupBy("doc_id").agg(F.sum(F.when(~F.col("bare"), F.col("n")).otherwise(0)).alias("n_tokens"), F.sum(F.when(F.col("original").isNotNull(), F.col("n")).otherwise(0)).alias("n_restorable"))
    return hits.where("n_tokens > 0")


def restored(docs: DataFrame) -> DataFrame:
    """The garbled documents with ``restored``: the garbled forms are replaced by their originals, longest first, but
    not inside clean words; and so do those that cannot be had back. The forms of a document are gathered
    per document, bounded by its own length."""
    some = F.collect_set(F.when(F.col("original").isNotNull(), F.struct("token", "form", "original"))).alias("_fixes")
    fixes = garbled_places(docs).groupBy("doc_id").agg(F.max(~F.col("bare")).alias("_real"), some).where("_real")

    @F.pandas_udf(T.StringType())
    def fix(text: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([repaired(t, [(x["token"], x["form"], x["original"]) for x in f]) for t, f in zip(text, fixes, strict=True)], dtype=object)

    return docs.join(fixes, "doc_id").withColumn("restored", fix("text", "_fixes")).drop("_fixes", "_real")


def repaired(text: str, fixes: list[tuple[str, str, str]]) -> str:
    """The text with the forms of ``fixes`` (token, form, original) replaced within the tokens named there and in those
    that are no clean words."""
    table = {form: original for _, form, original in fixes}
    if not table:
        return text
    forms = regex.compile("|".join(regex.escape(k) for k in sorted(table, key=len, reverse=True)))
    named = {t for t, _, _ in fixes}

    def mend(m: regex.Match) -> str:
        token = m.group(0)
        return forms.sub(lambda x: table[x.group(0)], token) if token in named or not is_clean(token.strip(EDGE)) else token

    return regex.sub(TOKEN.replace(r"\s", r" \t\n\x0b\f\r"), mend, text)
