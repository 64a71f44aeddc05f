"""Row-level decoders of positional JSON; plain Python, wrapped once by the operators."""
