"""Column expressions used inside the operators (all native, no Python per row)."""
