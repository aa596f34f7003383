"""An optional HTTP facade around one engine."""
