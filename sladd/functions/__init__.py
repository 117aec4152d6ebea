"""Column functions: spans, validators, context and false-positive rules."""
