"""Table schemas of the engine, as DDL."""

from __future__ import annotations

#: What a parser makes of a document: ``seq`` is the order within it.
ARTICLES = (
    "doc_id string, seq int, regulation string, article_number string, article_title string, chapter string, text string, "
    "source_url string, language string, doc_type string, doc_date date, in_force boolean, document_label string"
)
#: What is indexed: ``pos`` is the order of first insertion, which breaks ties in rankings.
CHUNKS = (
    "id string, pos bigint, text string, regulation string, article_number string, article_title string, chapter string, "
    "chunk_index int, total_chunks int, source_url string, language string, doc_type string, doc_date date, "
    "in_force boolean, document_label string, doc_id string"
)
#: A collection of regulations: one row each.
REGULATIONS = "regulation string, full_name string, celex string, url string, language string"
#: Documents beside the statutes.
DOCUMENTS = (
    "doc_id string, regulation string, parser string, doc_type string, doc_date date, in_force boolean, "
    "document_label string, full_name string, url string, language string"
)
RAW = "doc_id string, ext string, text string"
CHAT_LOG = "time timestamp, user string, question string, answer string, sources array<string>"
GOLD = (
    "id string, regulation string, difficulty string, language string, question string, expected_articles array<string>, notes string"
)
CASES = (
    "id string, mode string, regulation string, reg_a string, reg_b string, language string, failure_mode array<string>, "
    "question string, expected string, fail_condition string, "
    "checks struct<must_retrieve_articles:array<struct<regulation:string,article:string>>,"
    "must_retrieve_documents:array<struct<regulation:string,document_label:string>>,forbid_regex:array<string>,"
    "require_regex:string,require_no_citation:boolean,citations_from_only:array<string>>"
)
STABILITY = (
    "id string, category string, mode string, regulation string, reg_a string, reg_b string, question string, top_k int, "
    "must_retrieve_articles array<struct<regulation:string,article:string>>, citations_from_only array<string>, "
    "zero_citations boolean, answer_contains_any array<string>, answer_not_contains_any array<string>"
)
#: A ranked list per question; ``score_kind`` tells what the score is: bm25, cosine, rrf or reserved.
RESULTS = "query_id string, rank int, id string, score double, score_kind string"
