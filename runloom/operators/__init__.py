"""Operators over tables of runs, files, log lines, parameters and plans."""

from runloom.operators.contracts import (
    check_arg_specs,
    check_enum,
    check_keys,
    check_outputs,
    check_registry,
    check_summary,
    check_text,
    find_duplicates,
    match_steps,
)
from runloom.operators.history import (
    attach_params,
    attach_summary,
    check_steps,
    display_times,
    filter_ids,
    history,
    missing_steps,
    parameter_names,
    rank_recent,
    run_status,
    shape_columns,
    sort_recent,
)
from runloom.operators.identity import code_id, dataset_id, file_hashes, group_digest, param_id
from runloom.operators.lineage import link_train_run
from runloom.operators.logs import error_tail, show_increments
from runloom.operators.params import (
    clean_args,
    diff_plans,
    fill_defaults,
    flatten_params,
    infer_types,
    merge_plan,
    overlay_params,
    overlay_paths,
    select_ui_args,
    unknown_ui_args,
)
from runloom.operators.ranking import first_wins, latest_by_key, stage_durations
from runloom.operators.renewal import renew_dataset, store_dataset, stored_id
from runloom.operators.retention import apply_retention, finish_retention, retention_plan
from runloom.operators.sinks import append_run, read_ledger, replace_prefix, run_id, write_artifacts, write_ledger, write_output

__all__ = [
    "append_run",
    "apply_retention",
    "attach_params",
    "attach_summary",
    "check_arg_specs",
    "check_enum",
    "check_keys",
    "check_outputs",
    "check_registry",
    "check_steps",
    "check_summary",
    "check_text",
    "clean_args",
    "code_id",
    "dataset_id",
    "diff_plans",
    "display_times",
    "error_tail",
    "file_hashes",
    "fill_defaults",
    "filter_ids",
    "find_duplicates",
    "finish_retention",
    "first_wins",
    "flatten_params",
    "group_digest",
    "history",
    "infer_types",
    "latest_by_key",
    "link_train_run",
    "match_steps",
    "merge_plan",
    "missing_steps",
    "overlay_params",
    "overlay_paths",
    "param_id",
    "parameter_names",
    "renew_dataset",
    "replace_prefix",
    "retention_plan",
    "run_id",
    "rank_recent",
    "read_ledger",
    "run_status",
    "select_ui_args",
    "shape_columns",
    "show_increments",
    "sort_recent",
    "stage_durations",
    "store_dataset",
    "stored_id",
    "unknown_ui_args",
    "write_artifacts",
    "write_ledger",
    "write_output",
]
