"""Column expressions: everything here is a projection, none of it shuffles."""
