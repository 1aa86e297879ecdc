"""Stage store: cached artifacts by content key, frame records as JSON lines, ASS documents."""
