"""Column expressions: scripts, domains, evidence, geometry, text."""
