"""Guardrails (G1-G16, A7, A9, A10, A13, J5-J8): set-wise checks over all questions at once.

Each check gives one row per question with ``reason`` ('' lets it pass) and ``detail``; the first reason in order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternq.functions import text as tx
from lanternq.functions import udfs
from lanternq.functions.constants import ANAPHORA, CONTEXT_MARKS, GUARD, INJECTION_MARKER, INJECTIONS, NEGATION, PII, REFUSAL_TEMPLATE
from lanternq.plans.scale import broadcast_if_small, cut


def _none() -> Column:
    return F.array().cast("array<string>")


# --- vocabulary ---------------------------------------------------------------------------------------------------------


def vocabulary(chunks: DataFrame, min_df: int = 1) -> DataFrame:
    """``term, df``: stems of texts and breadcrumbs by number of chunks."""
    words = tx.stems(tx.tokens(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.array_join(F.coalesce("breadcrumb", _none()), " "))))
    return chunks.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def domain_coverage(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """``query_id, n_terms, coverage, unknown``: how much of each question's content words (numbers aside) the
    vocabulary knows. Questions without a content word have coverage 0 and no unknown word."""
    words = F.filter(tx.stems(F.coalesce(tx.tokens("text", True), _none())), lambda t: ~t.rlike("^[0-9]+$"))
    terms = queries.select("query_id", F.explode_outer(words).alias("term"))
    asked, _ = broadcast_if_small(cut(terms.select("term").distinct()), 40)
    known, _ = broadcast_if_small(cut(vocab.join(asked, "term", "left_semi").select("term", F.lit(True).alias("known"))), 40)
    rows = terms.join(known, "term", "left")
    n = F.count("term")
    return rows.groupBy("query_id").agg(
        n.alias("n_terms"), F.when(n > 0, F.count("known") / n).otherwise(0.0).alias("coverage"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("term")))).alias("unknown")
    )


# --- checks on questions --------------------------------------------------------------------------------------------------


def check_confidence(queries: DataFrame, results: DataFrame) -> DataFrame:
    """G1: no result, or a best match quality below the floor. Starts from the questions, so empty results count."""
    best = results.where("rank = 1").select("query_id", F.col("match_quality").alias("top"))
    reason = F.when(F.col("top").isNull(), "no_context_retrieved").when(F.col("top") < GUARD["min_top_score"], "low_retrieval_confidence").otherwise("")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", reason.alias("reason"), "top")


def check_domain(coverage: DataFrame, tops: DataFrame) -> DataFrame:
    """Too few known words, two unknown ones, or one unknown beside a mediocre match. No words: passes."""
    u = F.size("unknown")
    bad = (F.col("n_terms") > 0) & ((F.col("coverage") < GUARD["min_domain_coverage"]) | (u >= GUARD["max_unknown_terms"]) | ((u >= 1) & F.col("top").isNotNull() & (F.col("top") < GUARD["unknown_term_match_floor"])))
    return coverage.join(tops.select("query_id", "top"), "query_id", "left").select("query_id", F.when(bad, "out_of_domain").otherwise("").alias("reason"), "coverage", "unknown")


def check_ambiguity(queries: DataFrame, resolved: Column | None = None) -> DataFrame:
    """Too short, or a word that refers back with hardly anything else (unless memory has resolved it)."""
    words = F.filter(F.coalesce(tx.tokens("text", True), _none()), lambda t: ~t.rlike("^[0-9]+$"))
    back = F.filter(F.coalesce(tx.tokens("text"), _none()), lambda t: t.isin(*ANAPHORA))
    resolved = F.lit(False) if resolved is None else F.coalesce(resolved, F.lit(False))
    reason = F.when(F.size("_w") < GUARD["min_content_tokens"], "ambiguous_question").when(~resolved & (F.size("_b") > 0) & (F.size("_w") <= 2), "ambiguous_question").otherwise("")
    return queries.withColumn("_w", words).withColumn("_b", back).select("query_id", reason.alias("reason"), F.size("_w").alias("content_tokens"), F.col("_b").alias("evidence"))


# --- contradictions --------------------------------------------------------------------------------------------------------


def topical(label: Column, text: Column) -> Column:
    """Stems of a chunk's label and opening, numbers aside."""
    return tx.stems(F.filter(tx.tokens(F.concat_ws(" ", label, F.substring(text, 1, 240)), True), lambda t: ~t.rlike("^[0-9]+$")))


def check_contradiction(results: DataFrame, top_n: int = 3) -> DataFrame:
    """``query_id, reason, kind, first_rank, second_rank`` where two of the best results on one topic
    give far numbers of one unit about the same thing, or one phrase affirmed and denied. Pairs are of ranks i < j <= n
    within a question, so a question has n(n-1)/2 at most; the first pair wins, numbers before negation."""
    top = results.where(F.col("rank") <= top_n).select("query_id", "rank", "chunk_id", "label", "text")
    top = cut(top.withColumn("topic", topical(F.col("label"), F.col("text"))).withColumn("claims", udfs.numeric_claims()("text")).withColumn("words", tx.tokens("text")))
    a, b = top.alias("a"), top.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")))
    pairs = pairs.select(F.col("a.query_id").alias("query_id"), *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("rank", "text", "topic", "claims", "words")])
    pairs = pairs.withColumn("shared", tx.coverage("topic_a", "topic_b")).where("shared >= 0.5")
    ratio = GUARD["contradiction_ratio"]

    def same(x: Column, y: Column) -> Column:
        return (x["unit"] == y["unit"]) & F.arrays_overlap(x["context"], y["context"])

    def near(x: Column, y: Column) -> Column:
        return F.abs(x["value"] - y["value"]) <= ratio * F.greatest(F.abs(x["value"]), F.abs(y["value"]))

    def clash(x: Column) -> Column:
        others = F.filter("claims_b", lambda y: same(x, y))
        return (F.size(others) > 0) & ~F.exists(others, lambda y: near(x, y))

    numeric = F.exists("claims_a", clash) & ~F.exists("claims_a", lambda x: F.exists("claims_b", lambda y: same(x, y) & near(x, y)))
    pairs = pairs.withColumn("numeric", numeric).withColumn("p", udfs.longest_common_phrase(5)("words_a", "words_b"))

    def denied(text: str) -> Column:
        place = F.expr(f"instr({'_n_' + text}, p.phrase)")
        window = F.substring(F.col("_n_" + text), F.greatest(F.lit(1), place - 50), F.least(place, F.lit(51)) - 1 + F.length("p.phrase") + 30)
        return F.when(place > 0, window.rlike("(?i)" + NEGATION)).otherwise(F.lit(False))

    pairs = pairs.withColumn("_n_text_a", tx.normalize_text("text_a")).withColumn("_n_text_b", tx.normalize_text("text_b"))
    polar = (F.col("shared") > 0.6) & (F.col("p.phrase") != "") & (denied("text_a") != denied("text_b"))
    pairs = pairs.withColumn("kind", F.when(F.col("numeric"), "numeric").when(polar, "polarity")).where("kind is not null")
    first = Window.partitionBy("query_id").orderBy("rank_a", "rank_b")
    return pairs.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", F.lit("contradictory_sources").alias("reason"), "kind", F.col("rank_a").alias("first_rank"), F.col("rank_b").alias("second_rank"))


# --- injected instructions and personal data --------------------------------------------------------------------------------


def injections(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``<key>, kind, match`` for every instruction-shaped string, matches cut at 120 characters."""
    patterns = F.array(*[F.struct(F.lit("(?i)" + p).alias("p"), F.lit(k).alias("kind")) for p, k in INJECTIONS])
    quick = F.lower(F.col(text)).rlike("ignore|disregard|forget|you\\s+are\\s+now|new\\s|system|assistant|user|prompt|instruction|not\\s+(cite|mention|reveal)|answer|reply|respond|say|send|post|email|upload|execute")
    hits = texts.where(quick).select(F.col(key), F.col(text).alias("_t"), F.explode(patterns).alias("_p"))
    return hits.select(key, F.col("_p.kind").alias("kind"), F.explode(F.expr("regexp_extract_all(_t, _p.p, 0)")).alias("match")).withColumn("match", F.substring("match", 1, 120))


def has_injection(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p, _ in INJECTIONS)), F.lit(False))


def neutralized(text: Column, marker: str = INJECTION_MARKER) -> Column:
    """Paragraphs with embedded instructions give way to a marker."""
    return F.array_join(F.transform(F.split(text, "\n\n"), lambda p: F.when(has_injection(p), F.lit(marker)).otherwise(p)), "\n\n")


def sanitized(results: DataFrame) -> DataFrame:
    """Results with neutralised texts and a flag, untouched where nothing is found."""
    bad = has_injection(F.col("text"))
    return results.withColumn("neutralised", bad).withColumn("text", F.when(bad, neutralized(F.col("text"))).otherwise(F.col("text")))


def context_blocks(results: DataFrame, max_chars: int = 4000, neutralize: bool = True) -> DataFrame:
    """``query_id, context``: the results as fenced reference documents, in rank order. A question has at most as
    many as were retrieved for it."""
    body = F.substring(F.col("text"), 1, max_chars)
    body = F.regexp_replace(F.regexp_replace(body, "(?i)<document", "&lt;document"), "(?i)</document", "&lt;/document")
    body = neutralized(body) if neutralize else body
    piece = F.concat(F.lit('<document id="'), F.col("chunk_id"), F.lit('" source="'), F.coalesce("source", F.lit("")), F.lit('" section="'), F.coalesce("label", F.lit("")), F.lit('">\n'), body, F.lit("\n</document>"))
    lead = f"{CONTEXT_MARKS[0]}: documents found for the question, to be cited by id.\n{CONTEXT_MARKS[1]}\n\n"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"])
    return results.groupBy("query_id").agg(F.concat(F.lit(lead), F.array_join(ordered, "\n\n")).alias("context"))


def redact(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text with personal data replaced by [KIND_REDACTED], and the count of each kind, every pattern applied to
    what the ones before it left."""
    counts, out = {}, text
    for kind, pattern in PII:
        pattern = "(?U)" + pattern
        counts[kind.lower()] = F.coalesce(F.regexp_count(out, F.lit(pattern)), F.lit(0))
        out = F.regexp_replace(out, pattern, f"[{kind}_REDACTED]")
    return out, counts


# --- grounding -----------------------------------------------------------------------------------------------------------


def grounding(answers: DataFrame, cited: DataFrame, min_overlap: float = 0.6, min_phrase: int = 4) -> DataFrame:
    """``answer_id, n_claims, n_supported, groundedness``. A claim is supported when one cited text alone
    covers enough of its words or shares a long phrase. No claims: 1; claims but no cited text: 0. Claims are joined to
    their own answer's citations only; ``cited`` has ``answer_id, text``."""
    claims = answers.select("answer_id", F.posexplode(udfs.claim_sentences()("text")).alias("pos", "claim"))
    none = _none()
    claims = claims.withColumn("c_words", F.coalesce(tx.tokens("claim"), none)).withColumn("c_stems", tx.stems(tx.without_stopwords("c_words")))
    texts = cited.select("answer_id", F.coalesce(tx.tokens("text"), none).alias("t_words")).withColumn("t_stems", tx.stems("t_words"))
    pairs = claims.join(texts, "answer_id", "left").withColumn("share", F.when(F.col("t_words").isNull(), 0.0).otherwise(tx.coverage("c_stems", "t_stems")))
    pairs = pairs.withColumn("run", udfs.common_run(F.col("c_words"), F.coalesce("t_words", none), min_phrase))
    per = pairs.groupBy("answer_id", "pos").agg(F.max(((F.col("share") >= min_overlap) | (F.col("run") >= min_phrase)).cast("int")).alias("ok"))
    score = per.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.sum("ok").alias("n_supported"))
    zero = F.lit(0).cast("long")
    out = answers.select("answer_id").join(score, "answer_id", "left").withColumns({"n_claims": F.coalesce("n_claims", zero), "n_supported": F.coalesce("n_supported", zero)})
    return out.withColumn("groundedness", F.when(F.col("n_claims") > 0, F.col("n_supported") / F.col("n_claims")).otherwise(1.0))


def pre_answer(queries: DataFrame, results: DataFrame, vocab: DataFrame, resolved: Column | None = None, ambiguity: bool = True, domain: bool = True, contradiction: bool = True) -> DataFrame:
    """The first reason to refuse of each question, in the order ambiguity, confidence, domain, contradiction."""
    q = queries.select("query_id", "text", *(["resolved"] if "resolved" in queries.columns else []))
    confidence = cut(check_confidence(q, results))
    steps = [("c", confidence)]
    if ambiguity:
        steps.insert(0, ("a", check_ambiguity(q, resolved)))
    if domain:
        steps.append(("d", check_domain(domain_coverage(q, vocab), confidence)))
    if contradiction:
        steps.append(("x", check_contradiction(results)))
    out = q.select("query_id")
    for name, step in steps:
        out = out.join(step.select("query_id", F.col("reason").alias(name)), "query_id", "left")
    reason = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n, _ in steps], F.lit(""))
    return out.select("query_id", reason.alias("reason")).join(confidence.select("query_id", "top"), "query_id")


def refusal_text(detail: Column) -> Column:
    """G15."""
    return F.replace(F.lit(REFUSAL_TEMPLATE), F.lit("{detail}"), F.coalesce(detail, F.lit("")))
