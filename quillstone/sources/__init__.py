"""Sources: directories of files, metadata tables, evaluation sets, chunk files."""
