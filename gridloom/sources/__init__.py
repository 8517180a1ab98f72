"""Where grids come from: driver tables, files, NumPy arrays, generators."""
