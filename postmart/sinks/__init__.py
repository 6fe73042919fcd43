from postmart.sinks.manifest import append_rows, read_table, upsert_table  # noqa: F401
from postmart.sinks.publish import (  # noqa: F401
    append_new_jsonl, publish_snapshot, published_path, read_appended, read_published, replace_published,
    write_archive_jsonl, write_json_document, write_ranked_csv, write_run_state,
)
