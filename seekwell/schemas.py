"""Schemas of the engine's tables, as DDL that readers and parsers take."""

from __future__ import annotations

CRAWLED = "url string, content string, content_type string, last_crawled_seconds bigint, last_modified_ms bigint"
HEADER = "content_length int, content_type string, last_modified bigint"
HOST_STATE = "host string, last_accessed_ms bigint, rules string, is_invalid boolean, num_success int, num_fail int"
CRAWL_EDGES = "from_url string, to_urls array<string>"
DOCUMENT = "doc_id int, url string, content string, content_type string, visited_date bigint"
LINK = "doc_id int, to_doc_ids array<int>"
TAG_LINE = "doc_id bigint, kind string, idx int, tag string, text string"
WORD_HIT = "doc_id bigint, word string, tag string, pos int, cap int, context string"
DOC_WORD = "doc_id bigint, w string, tf bigint, ntf double"
LEXICON = "word_id bigint, w string, df bigint, idf double"
DOC_INFO = "doc_id bigint, url string, title string, context string"
RANK = "id bigint, rank double"
MATCH = "doc_id bigint, url string, title string, context string, features map<string,double>"
RESULT = "url string, type string, title string, display_text string, total_score double, features map<string,double>"
DOC_RANK = "doc_id bigint, score double, last_update bigint"
FEATURE = "name string, coeff double, use_log boolean"
POPULAR_KEYWORD = "keyword string, count bigint"
CONFIG = "name string, value int"
METRIC = "name string, metrics string, value double, ts timestamp"
USER = "username string, password_hash string, is_admin boolean"
CHANNEL = "name string, username string, created_date string, pattern string, doc_urls array<string>"
#: What crawl workers send each other: links, progress and the end.
MESSAGE = "type string, url string, worker int, count bigint"
EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
