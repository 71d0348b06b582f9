"""Empty on purpose: the operator inventory has no streaming part."""
