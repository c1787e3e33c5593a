"""Report plans built from the operators: hours, incidents, checks."""
