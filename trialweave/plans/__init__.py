"""Registered queries: importing this package fills the registry."""

from trialweave.plans import activity_plans, behavior_plans, compare_plans, opto_plans, sampling_plans, trace_plans, tuning_plans, window_plans  # noqa: F401
from trialweave.plans.registry import ORACLES, QUERIES  # noqa: F401
