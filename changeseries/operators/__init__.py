"""Table operators: series building, matrices, clustering, warping."""
