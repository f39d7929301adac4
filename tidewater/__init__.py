"""Effect propagation over dependency tables, and set, store and report operators around it, as Spark DataFrame jobs."""
