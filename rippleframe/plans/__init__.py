"""Query plans over features and sweep cells: projections, grids, horizons, contrasts."""
