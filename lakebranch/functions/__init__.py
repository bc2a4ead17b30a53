"""Column expressions: types, defaults, identifiers, fingerprints."""
