"""Fixed schemas, index fields, ranking features and settings."""

from __future__ import annotations

from dataclasses import dataclass

# The searchable fields in order, their weights and length normalisation.
FIELDS = ["title", "headings", "description", "anchor", "url", "body"]
FIELD_WEIGHTS = [5.0, 2.5, 2.0, 3.0, 1.5, 1.0]
FIELD_B = [0.5, 0.6, 0.6, 0.6, 0.5, 0.75]
K1 = 1.2
SYNONYM_FACTOR = 0.7

# Ranking features in order and the weights of the first model.
FEATURES = ["bm25", "coverage", "titleCoverage", "anchorCoverage", "phraseInTitle", "phraseInBody", "pageRank", "hostRank", "freshness", "shallowness", "clickThroughRate", "languageMatch"]
WEIGHTS = [1.0, 1.5, 0.4, 0.3, 0.3, 0.15, 0.4, 0.2, 0.1, 0.1, 0.5, 0.1]

SCHEMAS = {
    "pages": "id string, url string, url_hash long, shard_bucket int, host string, status string, title string, description string, headings string, content string, language string, "
    "content_hash string, simhash long, duplicate_of string, etag string, last_modified string, depth int, page_rank double, impressions int, clicks int, fetched_at timestamp, "
    "changed_at timestamp, next_crawl_at timestamp, revisit_interval double, fetch_count int, change_count int, updated_at timestamp",
    "links": "id string, source_url string, source_host string, target_url string, target_host string, anchor_text string",
    "hosts": "id string, origin string, host string, robots_txt string, robots_status string, robots_fetched_at timestamp, page_count int, host_rank double, blocked boolean, created_at timestamp",
    "frontier": "origin string, url string, depth int, retries int, kind string, seq long, next_allowed_at timestamp",
    "search_impressions": "id string, query string, normalized_query string, page int, payload struct<results:array<struct<url:string,position:int,features:array<double>>>>, model_version int, created_at timestamp",
    "search_clicks": "id string, impression_id string, position int, url string, created_at timestamp",
    "seeds": "id string, url string, enabled boolean, created_at timestamp",
    "ranking_models": "id string, version int, model struct<version:int,featureNames:array<string>,weights:array<double>>, trained_pairs int, created_at timestamp",
}


@dataclass(frozen=True)
class Settings:
    """Defaults of crawling, indexing and searching; times in seconds."""

    shards: int = 2
    candidates: int = 200
    max_per_host: int = 2
    anchors_per_page: int = 100
    links_per_page: int = 500
    snippet_chars: int = 160
    min_interval: float = 86_400.0
    initial_interval: float = 7 * 86_400.0
    max_interval: float = 90 * 86_400.0
    purge_after: float = 180 * 86_400.0
    min_delay: float = 1.0
    max_delay: float = 30.0
    max_retries: int = 3
    max_depth: int = 10
    max_url_bytes: int = 2048
    overlap: float = 2.0
    anchor_chars: int = 200
    query_chars: int = 200
    max_pages_per_host: int = 50_000
    max_queue_per_host: int = 100_000
    lease: float = 60.0
    robots_ttl: float = 86_400.0
    robots_error_ttl: float = 3_600.0
    sitemaps_per_host: int = 10
    urls_per_sitemap: int = 50_000
    training_days: int = 30
    minimum_pairs: int = 1_000
    max_segments: int = 8


DEFAULTS = Settings()
