"""Record shapes as DDL, for explicit schemas on read."""

from __future__ import annotations

LINES = "array<string>"
INVENTORY = "source string, package string, version string, license string, upstream string, author string, path string, area string, ext string, sha256 string, bytes bigint, n_lines bigint, normalized boolean"
PROVENANCE = "package string, version string, license string, license_partial boolean, author string, maintainer string, upstream string, bug_reports string, published string, tarball string, tarball_sha256 string, n_files bigint, n_bytes bigint, ingested_at string, rank int"
LEDGER = "package string, decision string, included boolean, license_class string, license_field string, flag string, reason string, tarball_sha256 string, tarball_bytes bigint, ts string"
EDIT_PAIR = f"lang string, repo string, sha string, path string, date string, prefix {LINES}, region_old {LINES}, cursor_idx int, region_new {LINES}, suffix {LINES}, event_diff string, is_test boolean, flags {LINES}"
SCENARIO = f"family string, package string, path string, prefix {LINES}, region_old {LINES}, region_new {LINES}, cursor_idx int, event_diff string, note string"
SFT_ROW = "text string, prompt string, target string, family string, package_or_repo string, has_types boolean"
CONVERSATION = "mid string, messages array<struct<role string, content string, index int>>, tags array<string>, languages array<string>"
INSTRUCTION = "id string, input string, output string, source_url string, license string, model string"
EVAL_RESULT = "i int, lang string, repo string, path string, sha string, is_test boolean, latency_s double, pred string, exact int, first_line int, line_f1 double, empty int, error string"
