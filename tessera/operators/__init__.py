"""DataFrame operators: search, ranking, graph, segmentation, packing, storage."""
