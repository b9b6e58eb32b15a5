"""Column functions; all run in the JVM."""
