"""Files, golden sets, versioned indexes."""
