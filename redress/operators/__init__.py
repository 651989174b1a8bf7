"""The analyses, one module per question (DataFrame -> DataFrame functions)."""
