"""Where ticks and reference data come from."""
