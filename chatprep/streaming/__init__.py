"""Structured Streaming: per-chat context state, routing, logs and prompts per arrival."""

from chatprep.streaming.context import (  # noqa: F401
    stream_context, stream_route, stream_append, stream_prompts, run_available_now, CONTEXT_OUT,
)
