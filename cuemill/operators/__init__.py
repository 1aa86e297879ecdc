"""Ordered-sequence operators on cues and frames, partitioned by media item."""
