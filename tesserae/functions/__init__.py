"""Column builders: no UDFs, everything stays in Catalyst expressions."""
