"""Schemas of the datasets."""

from __future__ import annotations

SFT = (
    "sft_index bigint, instruction string, input string, output string, topic string, "
    "concept string, concept2 string, difficulty string, template_type string"
)
PREFERENCE = (
    "prompt string, chosen string, rejected string, reason string, criteria_used array<string>, "
    "topic string, difficulty string, quality_difference double, degradation_strategy string, "
    "sft_index bigint"
)
EVAL_ITEM = "id string, prompt string, input string, reference string"
VERDICT = "id string, sft_response string, dpo_response string, verdict string, error string"
REQUEST = (
    "request_id bigint, command string, subject string, target string, time_available string, "
    "topic string, question string, student_answer string, reference_answer string, "
    "concept string, confusion_point string, current_level string"
)
ASSESSMENT = "student_id bigint, event_id bigint, topic string, assessment string"
