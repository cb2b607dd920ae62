"""Part of tidemark: functions."""
