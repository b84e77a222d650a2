"""Scans: datasets, file listings, run records, logs and URIs."""

from runloom.sources.datasets import (
    check_base_names,
    describe_files,
    empty_dataset,
    file_manifest,
    hash_files,
    load_tagged,
)
from runloom.sources.files import digest_files, list_files, list_folders, partition_name, write_small
from runloom.sources.logs import parse_log, read_log
from runloom.sources.queue import enqueue, queue_stream, trim
from runloom.sources.records import RUN_RECORD, RUN_SUMMARY, run_documents, run_folders, scan_run_records, scan_run_summaries
from runloom.sources.uris import classify_uris, profile_uris

__all__ = [
    "RUN_RECORD",
    "RUN_SUMMARY",
    "check_base_names",
    "classify_uris",
    "describe_files",
    "digest_files",
    "empty_dataset",
    "enqueue",
    "file_manifest",
    "hash_files",
    "list_files",
    "list_folders",
    "load_tagged",
    "parse_log",
    "partition_name",
    "profile_uris",
    "queue_stream",
    "read_log",
    "run_documents",
    "run_folders",
    "scan_run_records",
    "scan_run_summaries",
    "trim",
    "write_small",
]
