"""Column-level functions: Catalyst expressions (NFKC through ICU on the JVM; decimal places of
labels through a small Arrow function)."""
