"""Settings of the registered queries and the pipeline."""

from __future__ import annotations

from landsift.llm import mixing

# Topics are told apart by what a text contains; patterns hold for both engines.
MIX = mixing.Mix(
    languages={"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.1, "other": 0.05},
    topics={"markup": "[#*$%&<>]{3}", "legal": "(?i)licen[cs]e", "contact": "[0-9A-Za-z]@[0-9A-Za-z]|\\+[0-9]"},
    topic_shares={"markup": 0.02, "legal": 0.08, "contact": 0.1, "other": 0.8},
)
