"""Row types of observations, nodes, edges, files, history and runs."""

from __future__ import annotations

SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
RAW = "struct<language:string,parser:string,module:string,class_fqname:string,alias:string,style:string,level:int,message:string>"
EVIDENCE = f"struct<type:string,file_path:string,span:{SPAN},data:map<string,string>>"
#: ord is the place among the observations of a file; (file_path, ord) orders all of them.
OBSERVATION = f"ord bigint, kind string, repo_id string, file_path string, name string, fqname string, span {SPAN}, parent string, target string, signature string, doc string, raw {RAW}"
NODE = (
    f"node_id string, repo_id string, kind string, name string, fqname string, language string, file_path string, span {SPAN}, signature string, parent_id string, doc string, hash string, "
    f"confidence double, status string, version int, created_at string, updated_at string, provenance array<{EVIDENCE}>, history_ref array<string>"
)
EDGE = (
    f"edge_id string, repo_id string, src_id string, dst_id string, rel_type string, confidence double, evidence array<{EVIDENCE}>, score_breakdown map<string,double>, frequency bigint, "
    "status string, version int, created_at string, updated_at string, history_ref array<string>"
)
FILE = "file_path string, repo_id string, language string, content_hash string, size bigint, mtime_ns bigint, parse_status string, updated_at string"
HISTORY = f"event_id string, entity_type string, entity_id string, repo_id string, op string, reason string, actor string, timestamp string, patch map<string,string>, evidence array<{EVIDENCE}>"
RUN = "run_id string, repo_id string, mode string, status string, started_at string, finished_at string, duration_ms bigint, files_added int, files_changed int, files_deleted int, error string"

# Kinds of symbols.
DEFINITION_KINDS = ("class", "enum", "function", "interface", "method", "record", "selector", "struct", "trait")
NODE_KINDS = ("file", "module", *DEFINITION_KINDS)
REL_TYPES = ("CONTAINS", "DEFINES", "IMPORTS", "CALLS", "MAY_CALL", "INHERITS")
