"""User-level queries, composed of operators."""
