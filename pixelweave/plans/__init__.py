"""Plan helpers: stencils, tiles and weight tables."""
