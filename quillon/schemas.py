"""Schemas of the engine's tables; a missing attribute is an empty string, a rank that no channel gave is null."""

MANIFEST = "source string, company string, title string, date string, url string, path string, bytes bigint, sha256 string, content_type string, fetched_at string"
PAGE = (
    "doc_id string, source string, company string, title string, date string, url string, file string, unit string, strategy string, page int, text string, "
    "tables int, tables_dropped int, drop_reasons array<string>, chars int, kind string"
)
CHUNK = (
    "chunk_id string, doc_id string, source string, company string, title string, date string, url string, file string, unit string, page_start int, page_end int, "
    "section string, seq int, chars int, n_units int, period string, amount_unit string, table_title string, text string"
)
VECTOR = "chunk_id string, embedding array<float>"
QUERY = "query_id bigint, pos int, weight double, text string"
SPEC = (
    "n int, lib string, k int, q string, must array<string>, must_ans array<string>, min_companies int, need_lib map<string,int>, forbid_lib string, "
    "require_companies map<string,string>, min_from_company map<string,int>, panorama boolean, must_fail boolean"
)
