"""Schemas of the index tables."""

SYMBOL = "name string, qualified_name string, kind string, parent string, start_line int, end_line int, start_byte long, end_byte long, signature string, docstring string, is_exported boolean"
CALL = "callee string, receiver string, receiver_type_hint string, line int, start_byte long"
IMPORT = "module string, symbol string, alias string, line int"

RELATION = "owner string, kind string, name string, line int"
ERROR = "line int, found string"

FILES_RAW = "path string, language string, size_bytes long, mtime long, line_count int, content_hash string, is_test boolean, skipped_reason string, content binary"
COMMITS = "seq long, author string, author_date string, subject string, files array<string>"

FILES = "id long, path string, language string, size_bytes long, mtime long, line_count int, content_hash string, is_test boolean, parse_ok boolean, skipped_reason string"
SYMBOLS = f"id long, file_id long, {SYMBOL}"
CALLS = f"file_id long, ord int, {CALL}"
IMPORTS = f"file_id long, ord int, {IMPORT}, resolved_file_id long, go_dir string"
RELATIONS = f"file_id long, ord int, {RELATION}"
TYPE_EDGES = "type_id long, base_id long, kind string, confidence double, resolution string"
EDGES = "src_symbol_id long, dst_symbol_id long, dst_name string, line int, confidence double, resolution string"
COCHANGE = "file_a string, file_b string, both_count long, a_count long, b_count long, support double, conf_ab double, conf_ba double, lift double"
FILE_HISTORY = "path string, change_count long, last_changed string, top_authors string"
META = "key string, value string"

TABLES = {"files": FILES, "symbols": SYMBOLS, "calls": CALLS, "imports": IMPORTS, "relations": RELATIONS, "edges": EDGES, "type_edges": TYPE_EDGES, "cochange": COCHANGE, "file_history": FILE_HISTORY, "meta": META}
KEYS = {"cochange": ["file_a", "file_b"], "file_history": ["path"], "meta": ["key"]}
