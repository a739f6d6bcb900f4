"""Closed domains and state tables. They are part of the data format."""

from __future__ import annotations

SEGMENT_KINDS = ("dialogue", "narration", "menu_choice")
TOKEN_KINDS = ("interpolation", "text_tag", "escape")
TASK_STATUSES = ("pending", "running", "paused", "failed", "completed")
BATCH_STATUSES = ("pending", "running", "failed", "completed")
REQUEST_STATUSES = ("in_flight", "succeeded", "failed", "unknown")
QUALITY_OUTCOMES = ("clear", "low_confidence")
COMPATIBILITY_STATUSES = ("source_ready", "packaged_requires_import", "uncertain", "not_renpy")

#: Allowed moves of a task's status.
TASK_MOVES = {
    "pending": ("pending", "running", "paused"),
    "running": ("running", "paused", "failed", "completed"),
    "paused": ("paused", "running"),
    "failed": ("failed", "running"),
    "completed": ("completed",),
}
#: Allowed moves of a batch's status.
BATCH_MOVES = {
    "pending": ("pending", "running"),
    "running": ("running", "pending", "failed", "completed"),
    "failed": ("failed", "pending"),
    "completed": ("completed",),
}
#: Percent shown for each stage; translating has 45 more, by batches.
STAGE_PERCENT = {
    "preflight": 5,
    "extracting": 12,
    "sdk_crosscheck": 20,
    "translating": 25,
    "quality_check": 74,
    "rendering": 80,
    "validating_export": 88,
    "publishing": 96,
    "completed": 100,
}
LANGUAGE_NAMES = {
    "schinese": "Simplified Chinese",
    "zh-Hans": "Simplified Chinese",
    "tchinese": "Traditional Chinese",
    "zh-Hant": "Traditional Chinese",
}
#: Suffix to (kind, engine).
SUFFIXES = {
    ".rpy": ("script", "renpy"),
    ".rpym": ("script", "renpy"),
    ".ks": ("script", "kirikiri"),
    ".txt": ("text", None),
    ".json": ("structured_text", None),
    ".csv": ("structured_text", None),
    ".tsv": ("structured_text", None),
}
IGNORED_DIRECTORIES = (".git", ".venv", "__pycache__", "node_modules")
