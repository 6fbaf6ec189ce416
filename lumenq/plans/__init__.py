"""The SQL front end: what is rewritten before Spark sees a statement."""
