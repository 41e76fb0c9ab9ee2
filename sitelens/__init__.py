"""Website-structure analytics as Spark jobs over stored snapshots."""
