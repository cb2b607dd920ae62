"""Part of tidemark: streaming."""
