"""Fixed values of the run format."""

# Time patterns, as text in records and as shown in tables.
STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
DISPLAY_FORMAT = "yyyy-MM-dd HH:mm:ss"
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
EMPTY_STAMP = "20000101T000000Z"

# Ids that stand for "nothing".
EMPTY_DATA_ID = "000000000000"
NO_TRAIN_ID = "none"
EXTERNAL_MODEL_ID = "load-external-model"

# Output extensions.
TABLE_EXTENSIONS = (".csv",)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".svg")

# Areas of the artifact tree per run type.
ARTIFACT_AREAS = {
    "train": ("score", "output", "extra_output", "log", "report", "models"),
    "inference": ("score", "output", "extra_output", "log"),
}

# Interface modes between steps and allowed data types.
INTERFACE_MODES = ("memory", "file")
DATA_TYPES = ("table", "image")
RUN_TYPES = ("train", "inference")

# The columns of the history table, in order.
HISTORY_COLUMNS = (
    "id",
    "status",
    "start_time",
    "end_time",
    "score",
    "result",
    "note",
    "probability",
    "version",
    "data_id",
    "code_id",
    "param_id",
)
HISTORY_DROPPED = ("data_id_description", "code_id_description", "file_path")

# The keys of an experimental plan, parent and parent:child.
PLAN_KEYS = (
    "name",
    "version",
    "external_path",
    "external_path:load_train_data_path",
    "external_path:load_inference_data_path",
    "external_path:save_train_artifacts_path",
    "external_path:save_inference_artifacts_path",
    "external_path:load_model_path",
    "external_path_permission",
    "external_path_permission:aws_key_profile",
    "user_parameters",
    "asset_source",
    "control",
    "control:get_asset_source",
    "control:backup_artifacts",
    "control:backup_log",
    "control:backup_size",
    "control:interface_mode",
    "control:save_inference_format",
    "control:check_resource",
)
OPTIONAL_PLAN_KEYS = ("ui_args_detail",)
UNCHECKED_PLAN_KEYS = ("train_pipeline", "inference_pipeline")

# Defaults of the control section, as text.
CONTROL_DEFAULTS = {
    "get_asset_source": "once",
    "backup_artifacts": "True",
    "backup_log": "True",
    "backup_size": "1000",
    "interface_mode": "memory",
    "save_inference_format": "tar.gz",
    "check_resource": "False",
}

# Error code, name, comment.
ERROR_CODES = (
    ("E111", "SolutionMetadataReadError", "Failed to read Solution Metadata"),
    ("E112", "SolutionMetadataOverwriteError", "Failed to overwrite Solution Metadata into Experimental Plan"),
    ("E121", "ExperimentalPlanLoadError", "Failed to read Experimental Plan"),
    ("E122", "ExperimentalPlanPathUnspecified ", "Experimental Plan - external path unspecified"),
    ("E131", "AIPackageSetupFailure", "Failed to setup AI solution package"),
    ("E132", "AssetCodeSetupFailure", "Failed to setup AI solution asset code"),
    ("E141", "PipelineDataLoadError", "Failed to load data from external path"),
    ("E151", "AssetInitMethodFailure", "Failed to init asset"),
    ("E152", "AssetRunMethodFailure", "Failed to run asset"),
    ("E161", "InferenceSummaryCreationFailure", "Failed to create inference summary"),
    ("E162", "InferenceArtifactsCreationFailure", "Failed to create inference artifacts"),
)

# Result channels of a served request, in the order they are written.
SUMMARY_CHANNEL = "inference_summary"
ARTIFACTS_CHANNEL = "inference_artifacts"
