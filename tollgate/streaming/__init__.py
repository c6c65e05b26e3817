"""Streams: the same column functions as in batch, read with readStream and written with exactly-once file sinks."""
