"""streaming of folioscale."""
