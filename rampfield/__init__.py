"""Swept-probe analytics on Spark."""

from .params import FitParams, ScanParams

__all__ = ["FitParams", "ScanParams"]
