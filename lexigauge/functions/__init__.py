"""Column functions: text in, tokens and numbers out. All run inside the JVM."""
