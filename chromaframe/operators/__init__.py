"""Studies over pixels, clusters, recipes, depth and lines."""
