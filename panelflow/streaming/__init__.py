"""Event-time bars and the break monitor on streams."""

from panelflow.streaming import log
from panelflow.streaming.bars import session_bars, windowed_bars
from panelflow.streaming.monitor import break_events, regime_events
from panelflow.streaming.timed import timed_events, use_rocksdb

__all__ = ["break_events", "log", "regime_events", "session_bars", "timed_events", "use_rocksdb", "windowed_bars"]
