"""DataFrame operators: filters, voxels, spatial joins, scoring, registration, time series, tiles, analytics."""
