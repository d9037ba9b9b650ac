"""Column expressions: everything here stays inside the JVM and adds no stage to a plan."""
