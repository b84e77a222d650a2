"""Runs as lazy plans: steps, training and scoring."""

from runloom.plans.learning import (
    feature_stages,
    fit_step,
    load_model,
    pick_model,
    pick_models,
    score_step,
    select_xy,
    summarize_scores,
)
from runloom.plans.steps import Step, StepError, interface, native_step, pandas_step, run_steps, vector_step
from runloom.plans.trees import Forest, read_forest

__all__ = [
    "Forest",
    "Step",
    "StepError",
    "feature_stages",
    "fit_step",
    "interface",
    "load_model",
    "native_step",
    "pandas_step",
    "pick_model",
    "pick_models",
    "read_forest",
    "run_steps",
    "score_step",
    "select_xy",
    "summarize_scores",
    "vector_step",
]
