"""The user-level pipelines, composed from sources, functions and operators."""
