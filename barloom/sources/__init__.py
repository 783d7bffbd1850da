from .bars import scan_bars, scan_json_bars
from .datasets import (
    auxiliary_index, dataset_fingerprint, load_dataset, pk_order, publish_dataset, read_manifest,
    verify_dataset, verify_files, verify_years,
)
from .envelopes import envelope_findings, scan_raw_envelopes
from .vendor import (
    parse_adj_factors, parse_daily, parse_securities, parse_suspensions, parse_trade_cal,
)

__all__ = [
    "auxiliary_index", "dataset_fingerprint", "envelope_findings", "load_dataset",
    "parse_adj_factors", "parse_daily", "parse_securities", "parse_suspensions",
    "parse_trade_cal", "pk_order", "publish_dataset", "read_manifest", "scan_bars", "scan_json_bars", "scan_raw_envelopes",
    "verify_dataset", "verify_files", "verify_years",
]
