"""Row preparation, quality flags, measures, windows, upserts and generic checks."""
