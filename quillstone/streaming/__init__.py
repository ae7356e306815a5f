"""Streams: an index that follows a folder of chunks, and rates over a log of events."""
