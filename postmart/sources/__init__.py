from postmart.sources.files import scan_id_csv, scan_json_document, scan_jsonl_strict  # noqa: F401
from postmart.sources.html import extract_html_rows, extract_tag_attributes, extract_links  # noqa: F401
from postmart.sources.payloads import (  # noqa: F401
    inspect_pages, reply_summary, scan_bounty_replies, scan_day_records, scan_feed_pages, scan_reply_pages,
    scan_series_pages, scan_simulation_pages, scan_stats_payloads,
)
