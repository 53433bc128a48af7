"""Schemas of the stored tables."""

from __future__ import annotations

EVAL_DATASET = ("id string, question string, query string, expected_answer string, relevant_chunks array<string>, "
                "key_terms array<string>, type string")
CHUNKS = ("doc_id string, chunk_id string, text string, section string, page int, level string, type string, "
          "parent_id string, word_count int")
ANSWER_LOG = ("user_id bigint, subject string, topic string, is_correct boolean, ts timestamp, event_id bigint")
ACTIONS = "user_id bigint, action string, correct int, ts timestamp, event_id bigint"
QUOTA_REQUESTS = "user_id bigint, tier string, limit_type string, ts timestamp, event_id bigint"
MODEL_CALLS = "user_id string, provider string, total_tokens bigint, cost_usd double, ts timestamp"
INCOMING = "doc_id string, file_hash string, content string, ts timestamp"
