"""Readers, writers and adapters from the driver's tables onto the message schema."""

from chatprep.sources.tables import (  # noqa: F401
    read_table, messages_from_events, messages_from_conversations, live_from_events,
)
