"""Column functions: built-in expressions only, all evaluated inside the JVM."""
