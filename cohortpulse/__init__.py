"""Engagement analytics on Spark: clickstream features, cohorts and models."""

from cohortpulse.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
