"""Schemas of the tables that cross a file boundary."""

REQUEST = "request_id BIGINT, ts TIMESTAMP_NTZ, client STRING, url STRING"
SEED = "value STRING"
PAGE = "page_id BIGINT, url STRING, html STRING"
LOG = (
    "ts TIMESTAMP_NTZ, level STRING, msg STRING, jobId STRING, url STRING, hostname STRING,"
    " msBeforeNext BIGINT, error STRING, hash STRING, pageTitle STRING, count BIGINT,"
    " parentUrl STRING, workerId STRING, _corrupt_record STRING"
)
STORED_PAGE = "url_hash STRING, url STRING, html STRING, version BIGINT, run STRING, batch BIGINT, shard1 STRING"
INGEST = "id STRING, ts TIMESTAMP_NTZ, url STRING"
EVENT = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE,"
    " props STRING"
)
