from .bars import closing_tick, stream_bars, stream_dedup
from .features import stream_features
from .freshness import stream_freshness
from .quality import stream_quality
from .run import run_available, state_partitions, stream_table, streaming_session

__all__ = [
    "closing_tick", "run_available", "state_partitions", "stream_bars", "stream_dedup", "stream_features",
    "stream_freshness", "stream_quality", "stream_table", "streaming_session",
]
