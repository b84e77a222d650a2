"""Spark-native engine for the data side of machine-learning runs."""

from runloom.session import local_session, prepare, scratch_dir

__all__ = ["local_session", "prepare", "scratch_dir"]
