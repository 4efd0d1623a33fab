"""functions of folioscale."""
