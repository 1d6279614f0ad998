"""Schemas of the log, its batches and row changes."""

#: What reading a log returns, in this order.
LOG_COLUMNS = [
    "partition", "record_offset", "timestamp", "timestamp_type", "key", "value", "header_keys", "header_values",
    "leader_epoch", "producer_id", "producer_epoch", "sequence", "is_transactional",
]

#: The stored log: a row per record, with what its batch says about it.
STORED_SCHEMA = (
    "topic_id int, partition int, record_offset long, timestamp timestamp_ntz, timestamp_type string, key string, value string, "
    "header_keys array<string>, header_values array<string>, leader_epoch int, producer_id long, producer_epoch int, sequence int, "
    "is_transactional boolean, is_control boolean, base_offset long, last_offset long, segment_base long, append_ts long, size_bytes long"
)

CHANGE_SCHEMA = (
    "lsn long, end_lsn long, seq long, xid long, commit_ts timestamp_ntz, op string, schema string, `table` string, "
    "cols array<struct<name:string,type:string>>, new map<string,string>, old map<string,string>"
)

ISOLATION = ("read_committed", "read_uncommitted")
