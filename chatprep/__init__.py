"""chatprep: chat-corpus preparation and prompt building on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``) function
built from Spark SQL expressions, windows, joins and aggregates, so Catalyst can
push filters and prune columns and whole-stage codegen runs the hot path.

Main entry points::

    from chatprep import get_spark, training_examples, build_segments, segment_prompt
    from chatprep import context_at_each_message, route_messages, parse_responses, split_random
"""

from chatprep.session import get_spark, checkpoint_dir
from chatprep.operators.sequences import build_sequences, training_examples, sequence_stats
from chatprep.operators.segments import build_segments, segment_prompt, eval_pairs
from chatprep.operators.context import (last_n_per_chat, context_budget, context_at_each_message,
                                        chat_prompts_at_each_message, response_prompts)
from chatprep.operators.routing import Rule, route_messages, route_counts, default_rules, response_plan
from chatprep.operators.responses import parse_responses
from chatprep.operators.splits import split_random, split_ordered, shuffle_key
from chatprep.functions.sql import register_sql_functions

__all__ = [
    "get_spark", "checkpoint_dir", "build_sequences", "training_examples", "sequence_stats",
    "build_segments", "segment_prompt", "eval_pairs", "last_n_per_chat", "context_budget",
    "context_at_each_message", "chat_prompts_at_each_message", "response_prompts", "Rule",
    "route_messages", "route_counts", "default_rules", "response_plan", "parse_responses",
    "split_random", "split_ordered", "shuffle_key", "register_sql_functions",
]
