"""The engine's queries by name: each applies an operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravine.functions import fixed
from ravine.functions import text as tx
from ravine.functions import vectors as vx
from ravine.operators import boundaries, chunking, fusion, graph, ingest, kpi, lexical, relational, retrieve, tenancy, vector
from ravine.plans import stand_ins as si
from ravine.sources import files, leads
from ravine.sources.tables import deleted, table, updated, upserted
from ravine.sources.versions import Versioned, fingerprint, shared_folder, stored
from ravine.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# --- vectors


@query
def semantic_topk(s: SparkSession, d: str) -> DataFrame:
    """M0: the ten vectors most similar to vector 0."""
    v = si.vectors(s, d)
    asked = v.where("child_id = 0").first()["embedding"]
    near = vector.nearest(v, asked, 10)
    return near.select("child_id", _r("similarity").alias("similarity"))


@query
def semantic_batch_topk(s: SparkSession, d: str) -> DataFrame:
    """V2: a batch of query vectors."""
    return vector.similar(si.asked_vectors(s, d), si.vectors(s, d), 10).select("query_id", "child_id", _r("similarity").alias("similarity"), "rank")


@query
def semantic_topk_by_collection(s: SparkSession, d: str) -> DataFrame:
    """V3: within the query's own collection (label)."""
    return vector.similar(si.asked_vectors(s, d), si.vectors(s, d), 5, by=["label"]).select("query_id", "child_id", _r("similarity").alias("similarity"), "rank")


@query
def matryoshka_topk(s: SparkSession, d: str) -> DataFrame:
    """V7: by the first 16 dimensions."""
    return vector.similar(si.asked_vectors(s, d), si.vectors(s, d), 10, dims=16).select("query_id", "child_id", _r("similarity").alias("similarity"), "rank")


@query
def l2_normalize_check(s: SparkSession, d: str) -> DataFrame:
    """Lengths of normalised, truncated and late-truncated vectors."""
    v = vx.doubles(F.col("embedding"))
    return si.vectors(s, d).select(
        "child_id", _r(vx.norm(vx.normalized(v))).alias("unit"), _r(vx.norm(vx.matryoshka(v, 16))).alias("short"), _r(vx.norm(vx.truncated_after(v, 16))).alias("late"), F.size(vx.matryoshka(v, 16)).alias("dims")
    )


@query
def lsh_topk(s: SparkSession, d: str) -> DataFrame:
    """V8: approximate, from the stored index."""
    return si.vector_index(s, d).search(si.asked_vectors(s, d), 10)


# --- questions and text


@query
def keyword_extract(s: SparkSession, d: str) -> DataFrame:
    """Q2."""
    return si.questions(s, d).select("query_id", F.array_join(tx.keywords(F.col("text")), " ").alias("keywords"))


@query
def query_intent(s: SparkSession, d: str) -> DataFrame:
    """Q1 over every user's turn."""
    t = F.col("text")
    return table(s, d, "conversations").where("role = 'user'").select(
        "conv_id", "turn", tx.intent(t).alias("intent"), tx.requires_graph(t).alias("requires_graph"), F.when(tx.requires_graph(t), fixed.GRAPH_WEIGHT).otherwise(0.5).alias("graph_weight")
    )


@query
def content_hash_dedup(s: SparkSession, d: str) -> DataFrame:
    """The first document of each normalised content."""
    docs = table(s, d, "documents").withColumn("content_hash", tx.content_hash(F.col("text")))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query
def batch_dedup_first_wins(s: SparkSession, d: str) -> DataFrame:
    """I3 by (source, hash)."""
    docs = table(s, d, "documents").select("doc_id", "source", tx.raw_hash(F.col("text")).alias("hash"))
    return ingest.first_of_each(docs, ["source", "hash"], "doc_id")


@query
def idempotent_register(s: SparkSession, d: str) -> DataFrame:
    """English documents whose content no other language's documents registered before."""
    docs = table(s, d, "documents").select("doc_id", "lang", F.lit(1).alias("org_id"), tx.content_hash(F.col("text")).alias("hash"))
    return ingest.unregistered(docs.where("lang = 'en'"), docs.where("lang <> 'en'")).select("doc_id", "hash")


@query
def chunk_store_dedup(s: SparkSession, d: str) -> DataFrame:
    """Contents of the later half of the sources that the earlier half does not hold."""
    docs = table(s, d, "documents").select("doc_id", "source", tx.content_hash(F.col("text")).alias("content_hash"))
    old = docs.where("source < 'src15'")
    return ingest.new_chunks(docs.where("source >= 'src15'"), old, ["content_hash"], "doc_id")


@query
def token_estimate(s: SparkSession, d: str) -> DataFrame:
    """C1, by source."""
    return table(s, d, "documents").groupBy("source").agg(F.sum(tx.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("docs"))


@query
def section_heading(s: SparkSession, d: str) -> DataFrame:
    """C11."""
    return table(s, d, "documents").select("doc_id", tx.section_heading(F.col("text")).alias("heading")).where("heading is not null")


@query
def table_context(s: SparkSession, d: str) -> DataFrame:
    """Each nation's suppliers as a Markdown table, and what it is about."""
    sup = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"))
    rows = sup.groupBy("n_name").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("r")))).alias("x"))
    md = tx.rows_to_markdown(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("x", lambda x: x["r"])))
    return rows.select("n_name", md.alias("markdown")).select("n_name", "markdown", tx.table_context(F.col("markdown")).alias("context"), tx.is_table(F.col("markdown")).alias("is_table"))


@query
def ocr_confidence(s: SparkSession, d: str) -> DataFrame:
    """C20."""
    return table(s, d, "documents").select("doc_id", _r(tx.ocr_confidence(F.col("text"))).alias("confidence"))


@query
def regroup_chunks(s: SparkSession, d: str) -> DataFrame:
    """Five turns to a parent."""
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("chunk_index"), "text")
    return chunking.regroup(turns).select("document", "parent_index", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query
def outcome_classifier(s: SparkSession, d: str) -> DataFrame:
    """Outcome and sentiment of every conversation's transcript."""
    turns = relational.transcripts(table(s, d, "conversations"), "conv_id", "turn")
    return relational.outcomes(turns).select("conv_id", "outcome", "sentiment")


@query
def transcript_assembly(s: SparkSession, d: str) -> DataFrame:
    """A17."""
    return relational.transcripts(table(s, d, "conversations"), "conv_id", "turn").select("conv_id", "turns", F.md5("transcript").alias("transcript_md5"))


@query
def customer_text_only(s: SparkSession, d: str) -> DataFrame:
    """The customer's words."""
    return relational.transcripts(table(s, d, "conversations"), "conv_id", "turn").select("conv_id", F.md5("customer_text").alias("text_md5"), F.length("customer_text").alias("chars"))


@query
def phone_normalize(s: SparkSession, d: str) -> DataFrame:
    """P6, P7, on numbers made of customers' keys."""
    phone = F.concat(F.lit("+55 ("), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(") "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    c = table(s, d, "customer").select("c_custkey", phone.alias("phone"))
    return c.select("c_custkey", tx.phone_clean(F.col("phone")).alias("clean"), tx.e164(F.col("phone")).alias("e164"))


@query
def csv_lead_normalize(s: SparkSession, d: str) -> DataFrame:
    """Customers as leads with foreign heads."""
    c = table(s, d, "customer")
    rows = c.select(F.when(F.col("c_acctbal") > 0, F.lpad(F.col("c_custkey").cast("string"), 11, "5")).alias("Phone"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("segment"))
    return leads.leads(rows)


@query
def json_props_extract(s: SparkSession, d: str) -> DataFrame:
    """JSON columns: the property k by event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


@query
def html_pages(s: SparkSession, d: str) -> DataFrame:
    """Loader over web pages: the text without markup."""
    return table(s, d, "pages").select("page_id", F.md5(files.strip_html(F.col("html"))).alias("text_md5"))


@query
def file_types(s: SparkSession, d: str) -> DataFrame:
    """Kinds and MIME types of the pages' paths."""
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.element_at(F.array(*map(F.lit, [".pdf", ".MD", ".docx", ".png", ".bin"])), (F.col("page_id") % 5 + 1).cast("int")))
    p = table(s, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", tx.file_kind(F.col("path")).alias("kind"), tx.mime_type(F.col("path")).alias("mime_type"))


@query
def call_state_map(s: SparkSession, d: str) -> DataFrame:
    """Provider's call states, from orders' states."""
    name = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "In-Progress").otherwise("canceled")
    return table(s, d, "orders").groupBy(tx.call_state(name).alias("state")).agg(F.count("*").alias("n"))


@query
def yes_no_scores(s: SparkSession, d: str) -> DataFrame:
    """F10 over every assistant's turn."""
    return table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", tx.yes_no_score(F.col("text")).alias("score"))


# --- lexical


@query
def lexical_and_match(s: SparkSession, d: str) -> DataFrame:
    """L2, from the stored index."""
    return si.lexical_index(s, d).and_matches(si.questions(s, d))


@query
def lexical_tf_rank(s: SparkSession, d: str) -> DataFrame:
    """L4, L5, from the stored index."""
    return si.lexical_index(s, d).tf_search(si.questions(s, d), 50).select("query_id", "child_id", _r("score").alias("score"), "rank")


@query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """L11, from the stored index."""
    return si.lexical_index(s, d).bm25(si.questions(s, d), 20)


@query
def cover_density_rank(s: SparkSession, d: str) -> DataFrame:
    """L3."""
    return lexical.cover_density(si.questions(s, d), si.chunks(s, d), 50)


@query
def ilike_density_rank(s: SparkSession, d: str) -> DataFrame:
    """L7."""
    scored = lexical.density(si.chunks(s, d), "rights").select("child_id", _r("score").alias("score"))
    return scored.orderBy(F.desc("score"), "child_id").limit(50)


@query
def ilike_or_search(s: SparkSession, d: str) -> DataFrame:
    """P5."""
    return lexical.any_contains(table(s, d, "customer"), "machin", "c_name", "c_mktsegment").select("c_custkey", "c_name")


# --- fusion


def _channels(s: SparkSession, d: str, k: int = 50) -> dict[str, DataFrame]:
    """Lexical (BM25), semantic and graph candidates of the benchmark's queries.

    A query's vector is that of the document with its id. Graph candidates mention entities whose
    names hold a keyword of the query.
    """
    asked = si.questions(s, d)
    lex = si.lexical_index(s, d).bm25(asked, k).select("query_id", "child_id", "rank", "score")
    v = si.vectors(s, d)
    q = asked.join(v, F.col("query_id") == F.col("child_id")).select("query_id", "embedding")
    sem = vector.similar(q, v, k).withColumn("score", _r("similarity")).select("query_id", "child_id", "rank", "score")
    keywords = asked.select("query_id", tx.keywords(F.col("text")).alias("keywords"))
    entities, mentions, names = si.text_graph(s, d)
    met = graph.by_keywords(keywords, entities, mentions, 20, index=names).select("query_id", "child_id", "rank", _r("score").alias("score"))
    return {"lexical": lex, "semantic": sem, "graph": met}


def _fused(s: SparkSession, d: str) -> DataFrame:
    weights = {"lexical": fixed.LEXICAL_WEIGHT, "semantic": fixed.SEMANTIC_WEIGHT, "graph": fixed.GRAPH_WEIGHT}
    return fusion.fuse(_channels(s, d), weights)


@query
def rrf_two_channel(s: SparkSession, d: str) -> DataFrame:
    """unweighted."""
    c = _channels(s, d)
    return fusion.fuse({n: c[n] for n in ("lexical", "semantic")}).select("query_id", "child_id", _r("rrf_score").alias("rrf_score"), _r("lexical_score").alias("lexical_score"), _r("semantic_score").alias("semantic_score"))


@query
def rrf_weighted_three_channel(s: SparkSession, d: str) -> DataFrame:
    """F1, F2."""
    return _fused(s, d).select("query_id", "child_id", _r("rrf_score").alias("rrf_score"), "lexical_rank", "semantic_rank", "graph_rank", F.array_join("sources", ",").alias("sources"))


@query
def rrf_full_outer_sql(s: SparkSession, d: str) -> DataFrame:
    """F4, F5, J2."""
    c = _channels(s, d)
    return fusion.fuse_outer(c["lexical"], c["semantic"], 0.7, 0.8).select("query_id", "child_id", "rank_a", "rank_b", _r("rrf_score").alias("rrf_score"))


@query
def safety_threshold(s: SparkSession, d: str) -> DataFrame:
    """P12."""
    return fusion.safe(_fused(s, d), 0.6, "lexical_score", "semantic_score", "graph_score").select("query_id", "child_id", _r("rrf_score").alias("rrf_score"))


@query
def conformal_denoise(s: SparkSession, d: str) -> DataFrame:
    """P13."""
    rows = _fused(s, d).withColumn("rrf_score", _r("rrf_score", 9))
    return fusion.conformal(rows).select("query_id", "child_id", _r("rrf_score").alias("rrf_score"))


@query
def minmax_normalize(s: SparkSession, d: str) -> DataFrame:
    """F7."""
    return fusion.min_max(_fused(s, d), "rrf_score").select("query_id", "child_id", _r("normalized").alias("normalized"))


def _reranked(s: SparkSession, d: str) -> DataFrame:
    best = lexical.top(_fused(s, d).withColumn("rrf_score", _r("rrf_score", 9)), "rrf_score", 20).withColumnRenamed("rank", "original_rank")
    texts = best.join(si.chunks(s, d), "child_id").join(si.questions(s, d).withColumnRenamed("text", "question"), "query_id")
    similarity = F.coalesce("semantic_score", F.lit(0.0))
    score = fusion.lightweight_score(F.col("question"), F.col("text"), F.col("rrf_score"), similarity, tx.is_table(F.col("text")))
    return texts.withColumn("score", _r(score))


@query
def lightweight_rerank(s: SparkSession, d: str) -> DataFrame:
    """F8."""
    return lexical.top(_reranked(s, d), "score", 5).select("query_id", "child_id", "score", "rank")


@query
def relative_denoise(s: SparkSession, d: str) -> DataFrame:
    """P14."""
    return fusion.relative(_reranked(s, d), "score", 0.2, 0.6, 5).select("query_id", "child_id", "score", "rank")


@query
def refusal_status(s: SparkSession, d: str) -> DataFrame:
    """Which queries are refused, and why."""
    return fusion.refusals(si.questions(s, d), _reranked(s, d), "score", 0.3).select("query_id", "max_score", "reason", "refused")


def _parents(s: SparkSession, d: str) -> DataFrame:
    return si.chunks(s, d).groupBy("parent_id").agg(F.count("*").alias("children"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


@query
def parent_expansion(s: SparkSession, d: str) -> DataFrame:
    """J4, J5."""
    rows = lexical.top(_reranked(s, d), "score", 5).select("query_id", "child_id", "parent_id", "rank")
    return fusion.expand_parents(rows, _parents(s, d))


@query
def distinct_parents(s: SparkSession, d: str) -> DataFrame:
    """Each parent of a lexical match once."""
    met = si.lexical_index(s, d).and_matches(si.questions(s, d)).select(F.expr("child_id div 5").alias("parent_id"))
    return fusion.parents_of(met, _parents(s, d))


@query
def parent_with_children(s: SparkSession, d: str) -> DataFrame:
    """Orders as parents, their lines in order as children; orders without lines stay."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))
    return table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "parts")


def _retrieved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Retrieval as planned for each question, over parents of five chunks in order."""
    asked, held = si.questions(s, d), si.chunks(s, d)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("child_id", "text"))), lambda x: x["text"])
    parents = held.groupBy("parent_id").agg(F.array_join(ordered, "\n").alias("text"), F.count("*").alias("children"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))
    return retrieve.retrieve(asked, retrieve.planned(asked), _channels(s, d), held, parents, retrieve.Limits(refuse_under=0.2))


@query
def hybrid_retrieve(s: SparkSession, d: str) -> DataFrame:
    """The flagship: plans, three channels, the graph's only where a plan asks for it, fused by the plan's weights, reranked on parents, denoised."""
    return _retrieved(s, d)[0]


@query
def retrieval_status(s: SparkSession, d: str) -> DataFrame:
    """Every question's best score, and whether it is refused."""
    return _retrieved(s, d)[1].select("query_id", "max_score", "reason", "refused")


@query
def embedded_topk(s: SparkSession, d: str) -> DataFrame:
    """V9: questions and chunks through the embedder, and the five most similar; no vectors are given."""
    embed = boundaries.hashing_embedder(64)
    held = stored(boundaries.embedded(si.chunks(s, d), embed).select("child_id", "embedding"), "embedded")
    asked = stored(boundaries.embedded(si.questions(s, d), embed, "query_id").select("query_id", "embedding"), "embedded")
    return vector.similar(asked, held, 5, places=5).select("query_id", "child_id", "similarity", "rank")


@query
def scored_candidates(s: SparkSession, d: str) -> DataFrame:
    """the ten best lexical candidates of each question by a scorer in the workers."""
    rows = si.lexical_index(s, d).bm25(si.questions(s, d), 20).drop("rank").join(si.chunks(s, d).select("child_id", F.col("text").alias("content")), "child_id")
    rows = rows.join(si.questions(s, d).withColumnRenamed("text", "question"), "query_id")
    return boundaries.rescored(rows, boundaries.overlap_scorer, "score", 10).select("query_id", "child_id", _r("rerank_score").alias("rerank_score"))


@query
def retrieval_context(s: SparkSession, d: str) -> DataFrame:
    """the context of each query for a language model."""
    rows = fusion.relative(_reranked(s, d), "score", 0.2, 0.6, 5)
    return fusion.context(rows).select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


@query
def ndcg_mrr_recall(s: SparkSession, d: str) -> DataFrame:
    """Vectors of the query's own label are relevant."""
    v, asked = si.vectors(s, d), si.asked_vectors(s, d)
    # read by both of its uses below; labels are counted, and compared for the ranked pairs alone
    ranked = stored(vector.similar(asked, v, 10), "ranked")
    own = asked.select("query_id", "label")
    relevant = ranked.select("query_id", "child_id").join(own, "query_id").join(v.select("child_id", "label"), ["child_id", "label"]).select("query_id", "child_id")
    sizes = own.join(v.groupBy("label").agg(F.count("*").alias("relevant")), "label").select("query_id", "relevant")
    return kpi.ranking_quality(ranked, relevant, 10, sizes).select("query_id", *(_r(c).alias(c) for c in ("ndcg", "mrr", "precision", "recall")))


# --- chunking


@query
def chunk_parents(s: SparkSession, d: str) -> DataFrame:
    """C3, C4, C9."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunking.parents_and_children(docs)[0].drop("text")


@query
def chunk_children(s: SparkSession, d: str) -> DataFrame:
    """C9."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunking.parents_and_children(docs)[1].drop("text")


@query
def chunk_windows(s: SparkSession, d: str) -> DataFrame:
    """C12."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunking.flat_chunks(docs).select("document_id", "chunk_index", "content_hash")


@query
def ingest_documents(s: SparkSession, d: str) -> DataFrame:
    """What ingestion of all documents stores, by document."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    known = s.createDataFrame([], "org_id int, hash string")
    stored = s.createDataFrame([], "org_id int, content_hash string")
    return ingest.ingest_stats(ingest.ingest(docs, known, stored, 1)["children"])


# --- relational


@query
def category_counts(s: SparkSession, d: str) -> DataFrame:
    """A1."""
    return kpi.breakdown(table(s, d, "documents"), "source")


@query
def facts_by_type(s: SparkSession, d: str) -> DataFrame:
    """A10: orders' priorities as fact types."""
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("1-URGENT", "objection", "2-HIGH", "pain_point", "3-MEDIUM", "preference"))), F.col("o_orderpriority"))
    facts = table(s, d, "orders").select("o_custkey", kind.alias("fact_type"), F.col("o_orderstatus").alias("content"))
    return relational.bucketed_facts(facts, "o_custkey").select("o_custkey", "bucket", "facts", F.array_join("contents", "").alias("contents"))


@query
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    """The last order of each customer."""
    return fusion.latest(si.calls(s, d), ["customer_id"], F.desc("started_at"), F.desc("call_id")).select("customer_id", "call_id", "status")


@query
def call_history_topn(s: SparkSession, d: str) -> DataFrame:
    """The last three calls of each customer."""
    return relational.history(si.calls(s, d), "customer_id", "started_at", "call_id", 3).select("customer_id", "call_id", "rank")


@query
def pending_tasks_join(s: SparkSession, d: str) -> DataFrame:
    """J7, W8."""
    return relational.pending(si.tasks(s, d), si.customers(s, d), "customer_id").select("task_id", "name", "priority")


@query
def overdue_tasks(s: SparkSession, d: str) -> DataFrame:
    """P9."""
    return relational.overdue(si.tasks(s, d), F.lit("2000-01-01").cast("timestamp")).select("task_id", "customer_id")


@query
def customers_by_fact(s: SparkSession, d: str) -> DataFrame:
    """Customers with a matching fact, inner."""
    facts = lexical.any_contains(table(s, d, "orders"), "urgent", "o_orderpriority").select(F.col("o_custkey").alias("customer_id"), "o_orderkey")
    return facts.join(si.customers(s, d), "customer_id").groupBy("customer_id", "name").agg(F.count("*").alias("facts"))


@query
def anti_join_unsummarised(s: SparkSession, d: str) -> DataFrame:
    """Orders without lines."""
    return relational.without(table(s, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), table(s, d, "lineitem"), ["l_orderkey"]).select("l_orderkey")


@query
def enroll_leads_anti(s: SparkSession, d: str) -> DataFrame:
    """Building-sector customers without a pending order."""
    done = si.tasks(s, d).where("status = 'pending'")
    return relational.without(si.customers(s, d).where("segment = 'BUILDING'"), done, ["customer_id"]).select("customer_id", "name")


@query
def next_leads_semi(s: SparkSession, d: str) -> DataFrame:
    """J13."""
    return relational.within(si.customers(s, d), si.tasks(s, d).where("status = 'pending' and priority = '1-URGENT'"), ["customer_id"]).select("customer_id", "name")


@query
def calls_page_with_total(s: SparkSession, d: str) -> DataFrame:
    """A9, P8, W9."""
    rows = si.calls(s, d).where("status = 'completed' and started_at >= '1998-01-01'")
    return relational.page(rows, F.desc("started_at"), F.desc("call_id"), limit=50, offset=100).select("call_id", "customer_id", "total")


@query
def keyset_page(s: SparkSession, d: str) -> DataFrame:
    """W10."""
    return relational.keyset(si.events(s, d), ["ts", "event_id"], ("2024-01-10 00:00:00", 0), 50).select("event_id", "event_type", "has_more")


@query
def kpi_dashboard(s: SparkSession, d: str) -> DataFrame:
    """A2 to A4, by direction."""
    k = kpi.dashboard(si.calls(s, d), F.lit(si.NOW).cast("timestamp"), 90, ["direction"])
    return k.select("direction", "calls", "previous_calls", _r("avg_duration", 4).alias("avg_duration"), "active_calls", _r("change").alias("change"), "trend")


@query
def agent_performance(s: SparkSession, d: str) -> DataFrame:
    """By the customer's nation."""
    calls = si.calls(s, d).join(si.customers(s, d), "customer_id")
    report = kpi.agent_report(calls, "agent_id").join(table(s, d, "nation"), F.col("agent_id") == F.col("n_nationkey"))
    return report.select("n_name", "calls", "completed", _r("avg_duration", 4).alias("avg_duration"))


@query
def agent_totals(s: SparkSession, d: str) -> DataFrame:
    """A6."""
    totals = kpi.report_totals(kpi.agent_report(si.calls(s, d).join(si.customers(s, d), "customer_id"), "agent_id"))
    return totals.select("calls", "completed", _r("avg_duration", 4).alias("avg_duration"), _r("weighted_duration", 4).alias("weighted_duration"))


@query
def calls_report(s: SparkSession, d: str) -> DataFrame:
    """A7."""
    return kpi.calls_report(si.calls(s, d)).withColumn("avg_duration", _r("avg_duration", 4))


@query
def status_breakdown(s: SparkSession, d: str) -> DataFrame:
    """A8."""
    return kpi.breakdown(si.calls(s, d), "status")


@query
def availability_slots(s: SparkSession, d: str) -> DataFrame:
    """For each user hourly slots of January 2024 that no purchase (30 minutes from its time) overlaps."""
    e = si.events(s, d)
    busy = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end"))
    hours = F.explode(F.expr("sequence(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)")).alias("start")
    slots = e.select("user_id").distinct().select("user_id", hours).withColumn("end", F.col("start") + F.expr("INTERVAL 1 HOUR"))
    return relational.free_slots(slots, busy, "user_id").groupBy("user_id").agg(F.count("*").alias("free"))


@query
def schedule_gate(s: SparkSession, d: str) -> DataFrame:
    """P15."""
    days = F.array(*map(F.lit, ["mon", "tue", "wed", "thu", "fri"]))
    return si.events(s, d).where(relational.open_hours(F.col("ts"), days, F.lit("09:00"), F.lit("18:00"))).select("event_id")


@query
def tenant_scope(s: SparkSession, d: str) -> DataFrame:
    """One nation's customers, and the mentions of its suppliers' entities."""
    e = si.entities(s, d).join(table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_nationkey").alias("org_id")), "entity_id")
    return tenancy.scoped_mentions(si.mentions(s, d), e, 3).groupBy("entity_id").agg(F.count("*").alias("mentions"))


@query
def customer_prefetch(s: SparkSession, d: str) -> DataFrame:
    """J22."""
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "customer_id")
    key = F.col("o_orderkey").cast("string")
    facts = o.select("customer_id", key.alias("content"), F.col("o_orderdate").alias("created_at"))
    calls = o.select("customer_id", key.alias("summary"), F.col("o_orderdate").alias("call_date"))
    tasks = o.where("o_orderstatus = 'P'").select("customer_id", key.alias("description"), F.col("o_orderdate").alias("due_date"))
    out = relational.prefetch(si.customers(s, d), facts, calls, tasks, "customer_id")
    return out.select("customer_id", F.size(F.coalesce("facts", F.array())).alias("facts"), F.array_join("tasks", ",").alias("tasks"))


@query
def routing_chain(s: SparkSession, d: str) -> DataFrame:
    """suppliers' nations, regions and, in one region only, agents."""
    numbers = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("establishment_id"))
    places = table(s, d, "nation").select(F.col("n_nationkey").alias("establishment_id"), "n_name")
    runtimes = table(s, d, "nation").select(F.col("n_nationkey").alias("establishment_id"), F.col("n_regionkey").alias("agent_id"))
    agents = table(s, d, "region").where("r_regionkey = 1").select(F.col("r_regionkey").alias("agent_id"), "r_name")
    return relational.route(numbers, places, runtimes, agents).select("s_suppkey", "n_name", "r_name")


@query
def upsert_customers(s: SparkSession, d: str) -> DataFrame:
    """Customers, with new balances for one sector, without another."""
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0))
    kept = deleted(upserted(c, new, ["c_custkey"]), F.col("c_mktsegment") == "FURNITURE")
    return updated(kept, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(-1.0)})


# --- graph


@query
def graph_neighborhood(s: SparkSession, d: str) -> DataFrame:
    """G1: from every nation."""
    starts = si.entities(s, d).where("entity_type = 'NATION'").select(F.col("entity_id").alias("start"))
    return graph.neighborhood(starts, si.relations(s, d), si.mentions(s, d), 2, 50).select("start", "child_id", _r("score").alias("score"), "rank")


def _some_suppliers(s: SparkSession, d: str) -> DataFrame:
    """A stated set of starts: suppliers whose key is divisible by 50."""
    return table(s, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("start"))


@query
def graph_comention_neighborhood(s: SparkSession, d: str) -> DataFrame:
    """G1 through shared chunks: suppliers of one order are two edges apart."""
    return graph.neighborhood(_some_suppliers(s, d), si.relations(s, d), si.mentions(s, d), 2, 50).select("start", "child_id", _r("score").alias("score"), "rank")


def _paths(s: SparkSession, d: str) -> DataFrame:
    """From the stated suppliers to every nation, over relations and mentions."""
    nations = table(s, d, "nation").select(F.concat(F.lit("e:N"), F.col("n_nationkey").cast("string")).alias("dst"))
    pairs = _some_suppliers(s, d).select(F.concat(F.lit("e:"), "start").alias("src")).crossJoin(nations)
    return graph.paths(pairs, stored(graph.bipartite(si.relations(s, d), si.mentions(s, d)), "edges"), 4, sign=">")


@query
def graph_path_nodes(s: SparkSession, d: str) -> DataFrame:
    """The nodes of the least shortest path."""
    return _paths(s, d).select("src", "dst", "distance", F.array_join("path", ">").alias("path"))


@query
def graph_path_chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunks of every entity on the path."""
    return graph.path_chunks(_paths(s, d), si.mentions(s, d))


@query
def graph_lookup(s: SparkSession, d: str) -> DataFrame:
    """G2."""
    return graph.lookup(si.entities(s, d), si.mentions(s, d), "supplier#00000001", "SUPPLIER").select("entity_id", "child_id")


@query
def graph_related(s: SparkSession, d: str) -> DataFrame:
    """G4."""
    name = table(s, d, "nation").agg(F.min("n_name")).first()[0]
    return graph.related(si.entities(s, d), si.relations(s, d), name)


def _named(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as entities with two-word names, orders as chunks, and conversations' first words as keywords."""
    parts = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("name"))
    met = table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("entity_id"), F.col("l_orderkey").alias("child_id")).distinct()
    asked = table(s, d, "part").groupBy(F.col("p_brand").alias("query_id")).agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    return asked.select("query_id", F.array_distinct(F.split(F.element_at("names", 1), " ")).alias("keywords")), parts, met


@query
def graph_keyword_search(s: SparkSession, d: str) -> DataFrame:
    """G5, A12."""
    return graph.by_keywords(*_named(s, d), 20).select("query_id", "child_id", "matches", _r("score").alias("score"), "rank")


@query
def graph_shortest_path(s: SparkSession, d: str) -> DataFrame:
    """Between the suppliers of equal balance ranks, from each region's first to its last nation's."""
    n = table(s, d, "nation")
    ends = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("a"), F.max("n_nationkey").alias("b"))
    node = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    return graph.shortest_paths(ends.select(node("a").alias("src"), node("b").alias("dst")), si.relations(s, d), 4)


@query
def graph_fallback_search(s: SparkSession, d: str) -> DataFrame:
    """G7 to G10."""
    asked, parts, met = _named(s, d)
    kin = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("src"), (F.col("p_partkey") + 1).cast("string").alias("dst"))
    return graph.from_keywords(asked, parts, kin, met, 20).select("query_id", "child_id", "matches", "rank")


# --- metrics and events


@query
def histogram_buckets(s: SparkSession, d: str) -> DataFrame:
    """A14."""
    h = kpi.histogram(table(s, d, "events"), "value", [1.0, 5.0, 10.0, 25.0, 50.0], ["event_type"])
    return h.select("event_type", "le", "bucket", "count", _r("sum", 4).alias("sum"))


@query
def histogram_quantile(s: SparkSession, d: str) -> DataFrame:
    """The 95th percentile from buckets."""
    return kpi.bucket_quantile(kpi.histogram(table(s, d, "events"), "value", [1.0, 5.0, 10.0, 25.0, 50.0]), 0.95).select(_r("quantile").alias("quantile"))


@query
def timing_stats(s: SparkSession, d: str) -> DataFrame:
    """A15."""
    t = kpi.timing(table(s, d, "events"), "value", ["event_type"])
    return t.select("event_type", "count", _r("total", 4).alias("total"), "least", "most", _r("mean").alias("mean"))


@query
def stage_share(s: SparkSession, d: str) -> DataFrame:
    """A22."""
    return kpi.stage_shares(table(s, d, "events"), "value", "user_id", "event_type").select("user_id", "event_type", _r("share", 4).alias("share"))


@query
def rate_5m(s: SparkSession, d: str) -> DataFrame:
    """A20."""
    return kpi.rates(si.events(s, d), "ts", ["event_type"], "5 minutes").select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", _r("per_minute").alias("per_minute"))


@query
def metrics_exposition(s: SparkSession, d: str) -> DataFrame:
    """S17."""
    return kpi.prometheus(kpi.breakdown(table(s, d, "events"), "event_type"), "events_total", ["event_type"], "n")


@query
def event_dedup(s: SparkSession, d: str) -> DataFrame:
    """Each (user, type, hour) once."""
    e = si.events(s, d).select("user_id", "event_type", F.unix_timestamp(F.date_trunc("hour", "ts")).alias("hour_s"))
    return streams.once(e, ["user_id", "event_type", "hour_s"])


@query
def event_states(s: SparkSession, d: str) -> DataFrame:
    """T3, T4."""
    return streams.states(si.events(s, d), "user_id", "ts").select("user_id", "state", "events", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query
def final_status(s: SparkSession, d: str) -> DataFrame:
    """T7, in batch."""
    return streams.final_states(si.events(s, d), "user_id", "ts", ["click", "view"]).select("user_id", "state", "final")


@query
def fanout_bounded(s: SparkSession, d: str) -> DataFrame:
    """Every user subscribes to an event type, those whose id is divisible by 50 to all."""
    e = si.events(s, d).select("event_id", F.col("event_type").alias("channel"))
    users = si.events(s, d).groupBy("user_id").agg(F.min("event_type").alias("first"))
    subs = users.select(F.col("user_id").alias("subscriber"), F.when(F.col("user_id") % 50 == 0, "all").otherwise(F.col("first")).alias("channel"))
    return streams.fan_out(e, subs).select("subscriber", "event_id", "place")


@query
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of a day's gap, in batch."""
    out = streams.sessions(si.events(s, d), "ts", "user_id", "24 hours")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "events")


def _home(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid4().hex}"


@query
def committed_customers(s: SparkSession, d: str) -> DataFrame:
    """S15 by commits: as upsert_customers, each change one commit that a rerun does not repeat."""
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    t = Versioned(s, f"{shared_folder(s)}/customers-1-{fingerprint(s, f'{d}/customer.parquet')}", ("c_custkey",))
    t.upsert(c, "load")
    t.upsert(c.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.lit(0.0)), "building")
    t.delete(c.where("c_mktsegment = 'FURNITURE'").select("c_custkey"), "furniture")
    t.change(c.select("c_custkey"), {"c_acctbal": F.lit(-1.0)}, "negative", where=F.col("c_acctbal") < 0)
    return t.read()


@query
def ingest_status_commits(s: SparkSession, d: str) -> DataFrame:
    """Documents from pending to processing to completed or failed, each step a commit; empty ones fail."""
    docs = table(s, d, "documents").select("doc_id", "source", (F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0).alias("usable"))
    docs = docs.dropDuplicates(["doc_id"])
    t = Versioned(s, f"{shared_folder(s)}/statuses-1-{fingerprint(s, f'{d}/documents.parquet')}", ("doc_id",))
    t.upsert(docs.select("doc_id", "source", F.lit("pending").alias("status")), "register")
    t.change(docs.select("doc_id"), {"status": F.lit("processing")}, "start", where=F.col("status") == "pending")
    t.change(docs.where("usable").select("doc_id"), {"status": F.lit("completed")}, "finish", where=F.col("status") == "processing")
    t.change(docs.where("not usable").select("doc_id"), {"status": F.lit("failed")}, "fail", where=F.col("status") == "processing")
    return t.read().groupBy("source", "status").agg(F.count("*").alias("n"))


@query
def stream_kpis(s: SparkSession, d: str) -> DataFrame:
    """KPIs by day, computed by a stream over the events' file and collected in a table."""
    events = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    daily = streams.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "value", by=["event_type"])
    home = _home(s, "kpis")
    streams.drained(daily, lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/table"), f"{home}/checkpoint", "complete")
    return s.read.schema(daily.schema).parquet(f"{home}/table").select(F.unix_timestamp("start").alias("start_s"), "event_type", "events", _r("total", 4).alias("total"))
