"""DataFrame operators: search, rerank, filters, routing, chunking, matching, verification, metrics, index."""
