"""Flow CSV scan and the stores for fitted state, models and reports."""

from flowcascade.sources.flows import (
    NA_TOKENS,
    infer_numeric,
    normalize_columns,
    read_flow_text,
    read_flows,
    stage_clean_flows,
)
from flowcascade.sources.reports import write_report
from flowcascade.sources.state import load_models, load_state, save_models, save_state

__all__ = [
    "NA_TOKENS", "infer_numeric", "load_models", "load_state",
    "normalize_columns", "read_flow_text", "read_flows", "save_models",
    "save_state", "stage_clean_flows", "write_report",
]
