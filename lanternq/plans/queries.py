"""The core operators as queries over the engine's tables, whole tables and whole texts.

Keyword searches and fusions take as queries every answer whose id is divisible by 100, against all documents; whatever
reranks or answers takes the questions of all answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.functions import text as tx
from lanternq.functions import udfs
from lanternq.operators import answering, chunking, evaluation, guardrails, maintenance, rerank, retrieval, sessions
from lanternq.plans.engine import Config, Engine
from lanternq.plans.scale import cut, spread
from lanternq.sources import files
from lanternq.sources.tables import table
from lanternq.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def digest(words: Column) -> Column:
    return F.md5(F.array_join(words, "\n"))


# --- shared inputs ---------------------------------------------------------------------------------------------------------


def docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents"), "doc_id")


def latest_answers(s: SparkSession, d: str) -> DataFrame:
    """Each answer once, as it arrived last."""
    return maintenance.first_of(table(s, d, "answers"), "answer_id", [F.desc("arrived_at"), "text"])


def asked(s: SparkSession, d: str) -> DataFrame:
    """The searches' queries."""
    return latest_answers(s, d).where("answer_id % 100 = 0 and question is not null").select(F.col("answer_id").alias("query_id"), F.col("question").alias("text"))


def questions(s: SparkSession, d: str) -> DataFrame:
    """The questions of all answers."""
    return latest_answers(s, d).where("question is not null").select(F.col("answer_id").alias("query_id"), F.col("question").alias("text"))


def once(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every text once, under the least id it was asked under, and the ids (``query_id``) that each of these (``first``)
    stands for."""
    q = cut(q)
    first = cut(q.groupBy("text").agg(F.min("query_id").alias("query_id")))
    return first, cut(q.join(first.withColumnRenamed("query_id", "first"), "text").select("query_id", "first"))


def each(out: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for texts asked once, for every id they were asked under."""
    return out.withColumnRenamed("query_id", "first").join(members, "first").select(*out.columns)


def doc_chunks(s: SparkSession, d: str) -> DataFrame:
    """Every document as one chunk."""
    path = F.when(F.col("title").isNotNull(), F.array("title")).otherwise(F.array().cast("array<string>"))
    return docs(s, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", path.alias("breadcrumb"), F.lit(0).alias("index"), F.col("title").rlike(r"\?$").alias("is_question"), "source", "title", F.coalesce("title", "source", F.col("doc_id").cast("string")).alias("label"), "kind", F.lit(None).cast("string").alias("heading"))


def logged(s: SparkSession, d: str, q: DataFrame | None = None) -> DataFrame:
    """What the answers cited, ranked: a list to fuse with. One row per answer and document, the best one; with ``q``
    only of its questions."""
    c = table(s, d, "citations").where("doc_id is not null")
    c = c if q is None else c.join(q.select(F.col("query_id").alias("answer_id")), "answer_id", "left_semi")
    c = c.groupBy("answer_id", "doc_id").agg(F.max("score").alias("score"))
    return retrieval.top_k(c.select(F.col("answer_id").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), "score"), 20)


def gold(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "goldset").dropDuplicates(["qid"])


def search(s: SparkSession, d: str) -> tuple[DataFrame, retrieval.KeywordIndex]:
    q, index = cut(asked(s, d)), retrieval.build_index(doc_chunks(s, d))
    return q, index


# --- text functions ----------------------------------------------------------------------------------------------------------


@query
def normalize_whitespace(s, d):
    return docs(s, d).select("doc_id", tx.normalize_whitespace("text").alias("clean"))


@query
def normalize_text(s, d):
    return docs(s, d).select("doc_id", F.md5(tx.normalize_text("text")).alias("digest"))


@query
def tokenize(s, d):
    t = tx.tokens("text")
    return docs(s, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), digest(t).alias("digest"))


@query
def token_sets(s, d):
    t = F.array_sort(tx.token_set("text"))
    return docs(s, d).select("doc_id", F.size(t).cast("long").alias("n"), digest(t).alias("digest"))


@query
def stem_sets(s, d):
    t = F.array_sort(tx.stems(tx.tokens("text", True)))
    return docs(s, d).select("doc_id", F.size(t).cast("long").alias("n"), digest(t).alias("digest"))


@query
def question_coverage(s, d):
    a = latest_answers(s, d).where("question is not null and text is not null")
    q, t = tx.stems(tx.tokens("question", True)), tx.stems(tx.tokens("text"))
    return a.select("answer_id", F.round(tx.coverage(q, t), 6).alias("coverage"))


@query
def similarities(s, d):
    a = latest_answers(s, d).where("question is not null and text is not null")
    q, t = tx.tokens("question"), tx.tokens("text")
    return a.select("answer_id", F.round(tx.jaccard(q, t), 6).alias("jaccard"), F.round(tx.overlap(q, t), 6).alias("overlap"))


@query
def char_ngrams(s, d):
    g = tx.char_ngrams("question", 4)
    return latest_answers(s, d).where("question is not null").select("answer_id", F.size(g).cast("long").alias("n"), digest(g).alias("digest"))


@query
def common_phrases(s, d):
    a = latest_answers(s, d).where("question is not null and text is not null")
    p = udfs.longest_common_phrase(2)(tx.tokens("question"), tx.tokens("text"))
    return a.select("answer_id", p["length"].cast("long").alias("length"), p["phrase"].alias("phrase"))


@query
def document_keys(s, d):
    return docs(s, d).select("doc_id", tx.doc_key("text", "source").alias("key"))


@query
def boilerplate_filter(s, d):
    return docs(s, d).select("doc_id", F.md5(tx.without_boilerplate("text")).alias("digest"))


@query
def titles(s, d):
    return docs(s, d).select("doc_id", tx.first_heading("text").alias("heading"))


@query
def faq_documents(s, d):
    """The pairs as documents: P19, P20, P15, P21 on troubleshooting, the pair exported last."""
    t = maintenance.first_of(table(s, d, "troubleshooting"), "pair_id", [F.desc("loaded_at")]).where(tx.strip("answer") != "")
    text = tx.normalize_whitespace(tx.qa_markdown("question", "answer"))
    t = t.withColumn("text", text).where(F.length(F.trim("text")) >= files.MIN_CHARS)
    return t.select("pair_id", tx.doc_key("text", "source").alias("doc_key"), F.md5("text").alias("digest"), tx.first_filled(F.col("category"), F.col("product"), F.lit("general")).alias("topic"))


@query
def chunk_labels(s, d):
    return table(s, d, "citations").select("answer_id", "marker", tx.chunk_label(F.array(F.coalesce("label", F.lit(""))), F.lit(None).cast("string"), "source", "chunk_id").alias("label"))


# --- chunks -------------------------------------------------------------------------------------------------------------------


def _as_documents(s, d):
    return docs(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "title", "source", "kind")


@query
def fixed_chunks(s, d):
    return chunking.fixed(_as_documents(s, d)).select("doc_id", F.col("index").cast("long").alias("chunk_no"), "chunk_id", F.length("text").cast("long").alias("n_chars"))


@query
def section_tree(s, d):
    out = chunking.sections(docs(s, d))
    return out.select("doc_id", "section_no", tx.is_question("heading").alias("is_question"), F.col("level").cast("long").alias("level"), "heading", "path", F.col("n_lines").cast("long").alias("n_lines"), F.col("start_char").cast("long").alias("start_char"))


@query
def sentence_chunks(s, d):
    return chunking.sentence(_as_documents(s, d)).select("doc_id", "index", "chunk_id", "text")


@query
def structure_chunks(s, d):
    return chunking.structure(_as_documents(s, d)).select("doc_id", "index", "chunk_id", "label", "is_question", "part", "parts", "text")


@query
def sentences(s, d):
    return answering.sentence_frame(docs(s, d))


# --- index and retrieval ----------------------------------------------------------------------------------------------------------


@query
def term_frequencies(s, d):
    return retrieval.term_frequencies(retrieval.chunk_terms(doc_chunks(s, d))).select("chunk_id", "term", "tf")


@query
def inverse_frequencies(s, d):
    terms = cut(retrieval.chunk_terms(doc_chunks(s, d)))
    df = retrieval.document_frequencies(retrieval.term_frequencies(terms))
    return df.crossJoin(F.broadcast(retrieval.corpus_stats(terms))).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"), F.round(retrieval.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query
def bm25_search(s, d):
    q, index = search(s, d)
    return retrieval.bm25_search(q, index, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_filtered(s, d):
    """Only chunks of some kinds are candidates, statistics stay those of the corpus."""
    q, index = cut(asked(s, d)), retrieval.build_index(doc_chunks(s, d), keep=("kind", "source"))
    kept = retrieval.matches(kind=["markdown", "text"], source=lambda c: c.isNotNull())
    return retrieval.bm25_search(q, index, 5, where=kept).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def vector_search(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    q = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return retrieval.vector_search(q, e, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def vector_norms(s, d):
    e = F.col("embedding").cast("array<double>")
    first = F.transform(F.sequence(F.lit(1), F.size(e)), lambda i: F.lit(1.0))
    return table(s, d, "embeddings").select("vec_id", F.round(retrieval.cosine(e, first), 6).alias("cosine"))


@query
def rank_fusion(s, d):
    q, index = search(s, d)
    lists = [retrieval.bm25_search(q, index, 20), logged(s, d, q)]
    return retrieval.top_k(retrieval.fuse(lists, [1.0, 0.5]), 20).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query
def logged_fusion(s, d):
    """A keyword list and the citation log fused with both scores kept."""
    q, index = search(s, d)
    out = retrieval.hybrid(logged(s, d, q), retrieval.bm25_search(q, index, 20))
    return out.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"), "rank")


def _engine(s, d, **config) -> Engine:
    """An engine over all documents: structure chunks, their vectors, and the keyword index."""
    engine = Engine(s, Config(dim=64, **config))
    engine.add_documents(_as_documents(s, d))
    return engine


@query
def hybrid_retrieval(s, d):
    """From documents to chunks, vectors and index; vector and keyword search of every question, fused and reranked."""
    q, members = once(questions(s, d))
    out = _engine(s, d).retrieve(q)
    return each(out.select("query_id", "chunk_id", "doc_id", F.round("score", 6).alias("score"), F.round("pre_rerank_score", 6).alias("pre_rerank_score"), "match_quality", "rank"), members)


@query
def ask_many(s, d):
    """The whole way from a question to a checked answer with citations, or a reason why there is none."""
    q, members = once(questions(s, d))
    out = _engine(s, d).ask_many(q)
    return each(out.select("query_id", "answer", "refused", "refusal_reason", F.round("confidence", 4).alias("confidence"), F.round("groundedness", 4).alias("groundedness"), F.size("citations").alias("n_citations")), members)


def _features(s, d):
    (q, members), chunks = once(questions(s, d)), doc_chunks(s, d)
    index = retrieval.build_index(chunks)
    return q, members, rerank.feature_rows(cut(retrieval.bm25_search(q, index, 20)), q, chunks, index)


@query
def rerank_features(s, d):
    _, members, out = _features(s, d)
    names = ["f_retrieval", "f_lexical", "f_rare_term", "f_breadcrumb", "f_exact_phrase", "f_position", "f_question_shape", "f_length_penalty"]
    return each(out.select("query_id", "chunk_id", *[F.round(n, 6).alias(n) for n in names]), members)


@query
def reranked(s, d):
    _, members, feats = _features(s, d)
    out = rerank.rerank(feats, 5)
    return each(out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "match_quality", F.round("pre_rerank_score", 6).alias("pre_rerank_score")), members)


@query
def reranked_none(s, d):
    _, members, feats = _features(s, d)
    return each(rerank.without_rerank(feats, 5).select("query_id", "chunk_id", "rank", F.round("match_quality", 6).alias("match_quality")), members)


def _best(s, d):
    """Every text once, whom it stands for, and its five best documents with their texts."""
    q, members, feats = _features(s, d)
    return q, members, rerank.with_texts(cut(rerank.rerank(feats, 5).select("query_id", "chunk_id", "score", "rank", "match_quality")), q, doc_chunks(s, d))


@query
def hashed_embeddings(s, d):
    return docs(s, d).select("doc_id", udfs.embedder("hashing", dim=64)("text").alias("vector"))


# --- guardrails -----------------------------------------------------------------------------------------------------------------


@query
def vocabulary(s, d):
    return guardrails.vocabulary(doc_chunks(s, d), 2)


@query
def domain_coverage(s, d):
    vocab = guardrails.vocabulary(doc_chunks(s, d), 2)
    out = guardrails.domain_coverage(gold(s, d).select(F.col("qid").alias("query_id"), F.col("question").alias("text")), vocab)
    return out.select("query_id", "n_terms", F.round("coverage", 6).alias("coverage"), F.array_join("unknown", " ").alias("unknown"))


def _cited(s, d):
    return table(s, d, "citations").select(F.col("answer_id").alias("query_id"), "marker", F.col("score").alias("match_quality"), F.col("marker").alias("rank"))


@query
def confidence_check(s, d):
    q = latest_answers(s, d).select(F.col("answer_id").alias("query_id"))
    return guardrails.check_confidence(q, _cited(s, d)).select("query_id", "reason")


@query
def domain_check(s, d):
    vocab = guardrails.vocabulary(doc_chunks(s, d), 2)
    q = latest_answers(s, d).where("question is not null").select(F.col("answer_id").alias("query_id"), F.col("question").alias("text"))
    tops = guardrails.check_confidence(q, _cited(s, d))
    return guardrails.check_domain(guardrails.domain_coverage(q, vocab), tops).select("query_id", "reason")


@query
def ambiguity_check(s, d):
    q = latest_answers(s, d).select(F.col("answer_id").alias("query_id"), F.col("question").alias("text"))
    return guardrails.check_ambiguity(q).select("query_id", "reason", F.col("content_tokens").cast("long").alias("content_tokens"))


@query
def contradictions(s, d):
    c = table(s, d, "citations").where("doc_id is not null").select(F.col("answer_id").alias("query_id"), F.col("marker").alias("rank"), "chunk_id", "label", "doc_id")
    return guardrails.check_contradiction(c.join(docs(s, d).select("doc_id", "text"), "doc_id"))


@query
def injection_scan(s, d):
    a = latest_answers(s, d).where("text is not null").select(F.concat(F.lit("a"), F.col("answer_id").cast("string")).alias("key"), "text")
    return guardrails.injections(docs(s, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text").unionByName(a), "key").groupBy("key", "kind").agg(F.count("*").alias("n"))


@query
def neutralized(s, d):
    return docs(s, d).select("doc_id", F.md5(guardrails.neutralized(F.col("text"))).alias("digest"))


@query
def context_blocks(s, d):
    c = table(s, d, "citations").where("doc_id is not null").select(F.col("answer_id").alias("query_id"), F.col("marker").alias("rank"), "chunk_id", "source", "label", "doc_id")
    return guardrails.context_blocks(c.join(docs(s, d).select("doc_id", "text"), "doc_id")).select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


@query
def pii_redaction(s, d):
    return jobs.redacted_log(latest_answers(s, d).where("question is not null").select("answer_id", "question"))


@query
def grounding(s, d):
    a = latest_answers(s, d).where("text is not null").select("answer_id", "text")
    c = table(s, d, "citations").where("doc_id is not null").select("answer_id", "doc_id").join(docs(s, d).select("doc_id", "text"), "doc_id")
    return guardrails.grounding(a, c.select("answer_id", "text"))


@query
def guarded(s, d):
    q, members, best = _best(s, d)
    return each(guardrails.pre_answer(q, best, guardrails.vocabulary(doc_chunks(s, d), 2)), members)


# --- answers ---------------------------------------------------------------------------------------------------------------------


@query
def extractive_answers(s, d):
    q, members, best = _best(s, d)
    return each(answering.answers(q, best).select("query_id", "answer", "confidence", F.size("citations").alias("n_citations")), members)


@query
def prompts(s, d):
    q, members, best = _best(s, d)
    return each(answering.prompts(q, best).select("query_id", "prompt"), members)


@query
def citation_markers(s, d):
    """Markers by first use of a source among an answer's citations in order of position."""
    c = table(s, d, "citations").where("source is not null").select(F.col("answer_id").alias("query_id"), F.col("source").alias("chunk_id"), F.lit(0).alias("rank"), F.col("marker").alias("position"))
    return answering.with_markers(c).select("query_id", "position", F.col("marker").cast("long").alias("marker"))


@query
def parsed_citations(s, d):
    a = latest_answers(s, d).where("text is not null").select(F.col("answer_id").alias("query_id"), F.col("text").alias("raw"))
    known = table(s, d, "citations").select(F.col("answer_id").alias("query_id"), F.col("marker").cast("string").alias("chunk_id"))
    return answering.parsed_citations(a, known).select("query_id", F.col("marker").cast("long").alias("marker"), "chunk_id")


@query
def cited_documents(s, d):
    """The documents of each answer in order of first citation."""
    c = table(s, d, "citations").where("doc_id is not null").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("marker", "doc_id"))).alias("c"))
    ids = F.array_distinct(F.transform("c", lambda x: x["doc_id"].cast("string")))
    return c.select("answer_id", F.array_join(ids, " ").alias("doc_ids"))


# --- conversations ---------------------------------------------------------------------------------------------------------------


def turns(s, d):
    return latest_answers(s, d).select("session_id", F.col("answer_id").alias("turn"), "question")


@query
def entities(s, d):
    return turns(s, d).where("question is not null").select("turn", F.array_join(sessions.entities("question"), "|").alias("entities"))


@query
def follow_ups(s, d):
    return turns(s, d).where("question is not null").select("turn", sessions.needs_rewrite("question").alias("needs_rewrite"))


@query
def session_history(s, d):
    out = sessions.history(turns(s, d).where("question is not null and session_id is not null"))
    return out.select("session_id", "turn", F.size("history").cast("long").alias("n_history"), "entity")


@query
def session_rewrites(s, d):
    return sessions.rewritten_sessions(turns(s, d))


# --- evaluation --------------------------------------------------------------------------------------------------------------------


def _outcomes(s, d):
    """The goldset's questions as they were asked and answered in the log: the first answer to the same question."""
    g = gold(s, d).withColumn("question", F.trim("question"))
    a = maintenance.first_of(latest_answers(s, d).where("question is not null").withColumn("question", F.trim("question")), "question", ["answer_id"])
    first = g.select("qid", "question").join(a, "question").select("qid", "answer_id", F.col("text").alias("answer"), "refused", "groundedness", "latency_ms")
    c = table(s, d, "citations").where("source is not null").select("answer_id", F.col("marker").alias("rank"), "source")
    found = first.select("qid", "answer_id").join(c, "answer_id").select("qid", "rank", "source")
    cited = found.groupBy("qid").agg(F.collect_list("source").alias("cited_sources"))
    return evaluation.outcomes(g, found, first.drop("answer_id").join(cited, "qid", "left")), g


@query
def eval_outcomes(s, d):
    rows, _ = _outcomes(s, d)
    return rows.select("qid", F.col("first_rank").cast("long").alias("first_rank"), "refused", "content_ok", F.round("citation_precision", 6).alias("citation_precision"))


def _rounded(report: DataFrame, keep: list[str]) -> DataFrame:
    return report.select(*[c if c in keep else F.round(c, 6).alias(c) for c in report.columns])


@query
def eval_report(s, d):
    rows, _ = _outcomes(s, d)
    return _rounded(evaluation.report(rows), ["n", "n_answerable"])


@query
def eval_by_set(s, d):
    rows, g = _outcomes(s, d)
    return _rounded(evaluation.report(rows.join(g.select("qid", "set_name"), "qid"), "set_name"), ["set_name", "n", "n_answerable"])


@query
def eval_failures(s, d):
    rows, _ = _outcomes(s, d)
    return evaluation.failures(rows).select("qid")


@query
def latency_percentiles(s, d):
    p = [F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY latency_ms)").alias(f"p{int(100 * x)}_ms") for x in (0.5, 0.9, 0.95)]
    return latest_answers(s, d).groupBy("refused").agg(F.count("*").alias("n"), *p)


# --- index maintenance -------------------------------------------------------------------------------------------------------------


def _split(s, d):
    """The chunks indexed first, and the pages that came late: those late by up to ten days are edits of pages indexed
    before, later ones are new."""
    delay = F.unix_micros("loaded_at") - F.unix_micros("fetched_at")
    c = doc_chunks(s, d).join(docs(s, d).select("doc_id", (delay > 86_400_000_000).alias("late"), (delay > 864_000_000_000).alias("fresh")), "doc_id").select("doc_id", "chunk_id", "text", "source", "late", "fresh")
    old = c.where("not fresh").drop("late", "fresh")
    return old, c.where("late").drop("late", "fresh").withColumn("text", F.concat("text", F.lit(" updated")))


@query
def added_chunks(s, d):
    old, new = _split(s, d)
    return maintenance.add(old, new).select("chunk_id", F.md5("text").alias("digest"))


@query
def upserted_sources(s, d):
    """D2 by source: edited pages replace all chunks of their source."""
    old, new = _split(s, d)
    return maintenance.upsert(old, new, "source").select("chunk_id", F.md5("text").alias("digest"))


@query
def deleted_documents(s, d):
    old, new = _split(s, d)
    return maintenance.delete(old, new).select("chunk_id")


@query
def changed_frequencies(s, d):
    old, new = _split(s, d)
    index = retrieval.build_index(old)
    gone = index.postings.join(new.select("chunk_id"), "chunk_id", "left_semi")
    came = retrieval.term_frequencies(retrieval.chunk_terms(new))
    return maintenance.changed_frequencies(index.terms, gone, came)


@query
def upsert_stats(s, d):
    old, new = _split(s, d)
    return maintenance.upsert_stats(old, new)


@query
def store_stats(s, d):
    return maintenance.stats(doc_chunks(s, d))


# --- streams, as their batch twins ---------------------------------------------------------------------------------------------------


@query
def event_latencies(s, d):
    out = jobs.latencies(table(s, d, "events"), "ts", "value")
    return out.select("start", "n", F.round("mean", 6).alias("mean"))


@query
def numeric_claims(s, d):
    """Numbers with units per document."""
    c = docs(s, d).select("doc_id", F.explode(udfs.numeric_claims()("text")).alias("c"))
    return c.groupBy("doc_id", F.col("c.unit").alias("unit"), F.col("c.value").alias("value")).agg(F.count("*").alias("n"))


@query
def claim_sentences(s, d):
    """The sentences of each answer that claim something."""
    a = latest_answers(s, d).where("text is not null")
    return a.select("answer_id", F.posexplode(udfs.claim_sentences()("text")).alias("position", "sentence"))


@query
def candidate_sentences(s, d):
    """N1, F4 over what the answers cited."""
    a = latest_answers(s, d).where("question is not null").select(F.col("answer_id").alias("query_id"), "question")
    c = table(s, d, "citations").where("doc_id is not null").select(F.col("answer_id").alias("query_id"), F.col("marker").alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"))
    out = answering.candidates(c.join(a, "query_id").join(doc_chunks(s, d).select("chunk_id", "text", "heading", "title"), "chunk_id"))
    return out.select("query_id", "chunk_id", "rank", "position", "sentence", F.round("s_score", 6).alias("score"))


@query
def late_deliveries(s, d):
    """Answers once each, as they arrived last, and how often each came."""
    n = table(s, d, "answers").groupBy("answer_id").agg(F.count("*").alias("n_deliveries"))
    return latest_answers(s, d).join(n, "answer_id").select("answer_id", F.unix_micros("arrived_at").alias("arrived_us"), "n_deliveries")


@query
def retrieved_sources(s, d):
    """Cited documents with their texts' sizes and whether the source is one of the goldset's for the question."""
    a = latest_answers(s, d).where("question is not null").select("answer_id", F.trim("question").alias("question"))
    g = maintenance.first_of(table(s, d, "goldset").withColumn("question", F.trim("question")), "question", ["qid"]).select("question", "relevant_sources")
    c = table(s, d, "citations").join(docs(s, d).select("doc_id", F.length("text").cast("long").alias("n_chars")), "doc_id", "left")
    return c.join(a.join(g, "question"), "answer_id").select("answer_id", "marker", "n_chars", evaluation.relevant("source", "relevant_sources").alias("relevant"))
