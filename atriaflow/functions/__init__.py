"""Column expressions: vocabulary, conditioning, channels and time."""
