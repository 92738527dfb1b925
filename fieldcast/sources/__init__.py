"""Sources and sinks: driver-table fixtures, CSV/JSON assessment inputs, history tables."""
