"""Hopsight: place safety checks on multi-step agent traces with Spark DataFrames."""

from hopsight.plans.pipeline import Analysis

__all__ = ["Analysis"]
