"""The request loop as Structured Streaming queries."""

from runloom.streaming.outbox import guarded
from runloom.streaming.requests import (
    REQUEST_ENVELOPE,
    drain,
    parse_requests,
    queued_requests,
    request_arguments,
    request_stream,
)
from runloom.streaming.results import progress, read_channel, route_failures, success_messages
from runloom.streaming.serving import Service, read_artifacts, serve
from runloom.streaming.status import current_status, enrich_errors, error_table, latest_status, status_stream

__all__ = [
    "REQUEST_ENVELOPE",
    "Service",
    "current_status",
    "drain",
    "enrich_errors",
    "error_table",
    "guarded",
    "latest_status",
    "parse_requests",
    "progress",
    "queued_requests",
    "read_artifacts",
    "read_channel",
    "request_arguments",
    "request_stream",
    "route_failures",
    "serve",
    "status_stream",
    "success_messages",
]
