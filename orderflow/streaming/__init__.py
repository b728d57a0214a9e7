"""Structured Streaming forms of the operators (readStream -> ... -> checkpointed sink)."""

from orderflow.streaming.runner import run_available_now, events_stream, table_stream
from orderflow.streaming.sinks import append_batch
from orderflow.streaming.gate import gate_event_time, gate_stream

__all__ = ["run_available_now", "events_stream", "table_stream", "append_batch", "gate_stream", "gate_event_time"]
