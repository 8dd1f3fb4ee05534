"""Column-level helpers: numeric, network and hashing expressions."""
