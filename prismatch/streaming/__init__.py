"""Request admission, in batch and on streams."""
