"""Schemas of the engine's tables, as DDL; nested types are named so they can be reused."""

CHUNK = "id string, repo_provider string, repo_owner string, repo_name string, repo_ref string, path string, kind string, language string, content string, line_start int, line_end int, indexed_at long"
#: Columns that the store keeps beside a chunk's own: symbols, their kind and the vector with its width.
CHUNK_EXTRA = "symbols array<string>, symbol_kind string, exported boolean, embedding array<float>, dim int"
STORED_CHUNK = f"{CHUNK}, {CHUNK_EXTRA}"
METADATA = (
    "repository_provider string, repository_id string, commit_sha string, embedding_provider string, embedding_model string, "
    "embedding_dimension int, chunk_strategy string, chunk_version int, engine_version string, default_branch string, created_at long"
)
SOURCE = "struct<kind:string,path:string,name:string,sha:string,id:string,label:string>"
HUNK = "struct<start_line:int,end_line:int,content:string>"
DIFF_FILE = f"struct<path:string,patch:string,hunks:array<{HUNK}>>"
SIGNAL = "struct<type:string,severity:string,confidence:double,file:string,line_start:int,line_end:int,message:string,rationale:string,suggested_fix:string>"
USAGE = "struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>"
EVENT = "ts timestamp, event string, fields map<string,string>"
SNAPSHOT = "ref string, path string, oid string"
DECLARATION = "side string, path string, name string, kind string, start_line int, end_line int, signature string"
MEMBER = "side string, owner string, member string, marker string"
REFERENCE = "symbol string, path string, line_start int, line_end int, ref_kind string, is_test boolean"
RUN = f"scenario string, model string, run int, duration_ms long, outcome string, signals array<struct<file:string,message:string>>, usage {USAGE}, error string"
JOB = "id string, type string, state string, created_at long, started_at long, finished_at long, error string"
CHECK = "name string, status string, detail string"
