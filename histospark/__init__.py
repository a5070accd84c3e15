"""histospark — plant-historian analytics written as Spark DataFrame jobs.

Sensor feeds in long, wide and single-signal form are registered, their stream
names parsed into (asset, signal), classified into industrial domains,
normalised into one readings table and analysed for all signals in one
distributed pass (statistics, trends, rolling z-score anomalies, damped-trend
forecasts, freshness and health), together with the bookkeeping tables around
them.
"""

from histospark.session import get_session, workspace_dir
from histospark.context import Historian

__all__ = ["Historian", "get_session", "workspace_dir"]
