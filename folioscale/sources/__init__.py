"""sources of folioscale."""
