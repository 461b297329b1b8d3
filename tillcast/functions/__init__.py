"""Column expressions: Column in, Column out, all JVM-side."""
