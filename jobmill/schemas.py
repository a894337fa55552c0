"""Explicit schemas; nothing is inferred."""

LISTING = (
    "id string, title string, original_url string, content_html string, source string, _cat string, "
    "applicant_count bigint, applicant_count_display string, applicant_metric_label string, "
    "applicant_metric_note string, applicant_metric_basis string, states array<string>, state_label string, "
    "official_state_portal string, company string, job_location string, salary string, experience string, "
    "posted_at string, skills array<string>"
)
MANUAL_ROW = (
    "id string, title string, org string, cat string, state string, url string, vac bigint, lastDate string, "
    "badge string, note string, type string, cutoff string, date string, status string, examDate string, "
    "relDate string, keytype string, objDate string"
)
DIRECTORY_ENTRY = "name string, type string, portal_url string, aliases array<string>"
ARRAY_FEED_ITEM = (
    "id string, position string, company string, location string, salary_min variant, salary_max variant, "
    "date string, tags array<string>, url string, apply_url string, description string"
)
JOBS_FEED_ITEM = (
    "url string, title string, company_name string, candidate_required_location string, salary string, "
    "publication_date string, tags array<string>, description string"
)
RSS_ITEM = "title string, link string, description string, pubDate string, category array<string>"


def as_struct(columns: str) -> str:
    """``a string, b bigint`` -> ``struct<a:string,b:bigint>``."""
    parts = []
    for part in columns.split(", "):
        name, kind = part.strip().split(" ", 1)
        parts.append(f"{name}:{kind}")
    return "struct<" + ",".join(parts) + ">"


DIRECTORY = f"struct<states:array<{as_struct(DIRECTORY_ENTRY)}>>"


def snapshot_schema(categories: tuple[str, ...]) -> str:
    arrays = ", ".join(f"{c} array<{as_struct(LISTING)}>" for c in categories)
    return f"status string, scraped_at string, {arrays}"


def manual_schema(keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} array<{as_struct(MANUAL_ROW)}>" for k in keys)
